import json

import pytest
from pyspark.sql import functions as F

from wordloom.functions.json import is_truthy, strict_json
from wordloom.operators.results import (
    error_rows,
    parse_lines,
    quarantine_rows,
    route_errors,
    route_results,
    word_entries,
)
from wordloom.session import stage
from wordloom.sources.files import document_rows, read_json_lines, read_result_documents, unread_documents


def result(custom_id, content="{}", refusal=None, error=None, **message):
    body = {"id": "c", "choices": [
        {"index": 0, "finish_reason": "stop", "logprobs": None,
         "message": {"role": "assistant", "content": content, "refusal": refusal, **message}},
        {"index": 1, "message": {"content": "never read", "refusal": "never read"}},
    ], "usage": {"total_tokens": 3}}
    response = {"status_code": 200, "request_id": "r", "body": body}
    return {"id": "b", "custom_id": custom_id, "response": response, "error": error}


def payload(*entries):
    return json.dumps({"response": [{"word": w, "translations": t} for w, t in entries]},
                      ensure_ascii=False)


AALE = payload(("Aal", {"noun": ["eel"], "verb": [], "other": ["x"]}), ("Ä b", {"noun": ["a b"]}))


@pytest.mark.parametrize("text", [
    '{"a":1}', " {\"a\": [1, 2]} ", "null", "1", "-1.5e3", '"x"', "[]", "[1,2]", "true",
    '{"a":"]},{"}', '{"é":"\\u00e9"}', "[[]]",
])
def test_strict_json_accepts(spark, text):
    df = spark.createDataFrame([(text,)], "t STRING")
    got = df.select(F.to_json(strict_json(F.col("t")))).first()[0]
    assert json.loads(got) == json.loads(text)


@pytest.mark.parametrize("text", [
    "", " ", '{"a":1} x', "1,2", "1],[2", '1,"b":2', '1},{"v":2', "{", "]", "[1", "{'a':1}",
    "01", "NaN", "tru", '{"a":1}{"b":2}', "1 2", "1]", "1}", '{"a":1,}', "// c", "[1] [2]",
])
def test_strict_json_refuses(spark, text):
    df = spark.createDataFrame([(text,)], "t STRING")
    assert df.select(strict_json(F.col("t")).isNull()).first()[0]


def test_truth(spark):
    cases = {"null": False, '""': False, "0": False, "false": False, "0.0": False, "{}": True,
             "[]": True, '"x"': True, "1": True, "true": True, '"0"': True, '"false"': True}
    df = spark.createDataFrame(list(cases.items()), "t STRING, want BOOLEAN")
    rows = df.select("t", "want", is_truthy(F.parse_json("t")).alias("got")).collect()
    assert [r.t for r in rows if r.got != r.want] == []
    missing = F.try_variant_get(F.parse_json(F.lit("{}")), "$.a", "variant")
    assert spark.range(1).select(is_truthy(missing)).first()[0] is False


def route(spark, tmp_path, *lines):
    text = "\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines)
    (tmp_path / "batch_1").write_text(text)
    return stage(route_results(parse_lines(read_json_lines(spark, str(tmp_path)))))


def test_every_route(spark, tmp_path):
    cases = [
        (result("ok", AALE), "word", None),
        (result("e", error={"message": "no"}), "error", None),
        (result("e0", AALE, error={}), "error", None),
        (result("e1", AALE, error=""), "word", None),
        (result("e2", AALE, error=0), "word", None),
        (result("e3", error="x", refusal="y"), "error", None),
        (result("r", AALE, refusal={"reason": "no"}), "refusal", None),
        (result("r1", AALE, refusal=""), "word", None),
        ({"custom_id": "x", "error": {"code": 1}, "response": {"body": {"choices": []}}},
         "error", None),
        ({"custom_id": "x", "error": None, "response": {"body": {"choices": []}}},
         "quarantine", "no message"),
        ({"custom_id": "x", "error": None}, "quarantine", "no message"),
        ({"custom_id": "x", "error": None, "response": None}, "quarantine", "no message"),
        ("5", "quarantine", "no message"),
        (result("n", None), "quarantine", "no content"),
        (result("o", {"response": []}), "quarantine", "no content"),
        (result("b", '{"response": [ {'), "quarantine", "malformed content"),
        (result("b1", AALE + " x"), "quarantine", "malformed content"),
        (result("l", '{"answer": []}'), "quarantine", "no list of entries"),
        (result("l1", "[]"), "quarantine", "no list of entries"),
        (result("l2", "null"), "quarantine", "no list of entries"),
        (result("empty", '{"response": []}'), "word", None),
        ('{"custom_id": "m", \t"x"', "quarantine", "malformed line"),
        ('{"a":1} x', "quarantine", "malformed line"),
    ]
    lines = [line for line, _, _ in cases]
    routed = route(spark, tmp_path, "", *lines[:9], "null", "  ", *lines[9:], "")
    rows = routed.orderBy("block", "line_id").collect()
    assert [(r.route, r.reason) for r in rows] == [(want, why) for _, want, why in cases]
    errors = {r.custom_id: (r.type, json.loads(r.error)) for r in error_rows(routed).collect()
              if r.custom_id != "x"}
    assert errors == {
        "e": ("error", {"message": "no"}), "e0": ("error", {}), "e3": ("error", "x"),
        "r": ("refusal", {"reason": "no"}),
    }
    aside = {(r.reason, r.line): r.stage for r in quarantine_rows(routed).collect()}
    assert aside[("malformed line", '{"custom_id":"m","x"')] == "result"
    assert aside[("malformed content", '{"response":[{')] == "content"


def test_words_in_order_with_positions(spark, tmp_path):
    contents = [payload(*[(f"w{n}-{i}", {"noun": [str(i)]}) for i in range(n % 4)])
                for n in range(200)]
    lines = [result(str(n), c, error="x" if n % 7 == 0 else None) for n, c in enumerate(contents)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        routed = route(spark, tmp_path, *lines)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert routed.select("block").distinct().count() > 5
    rows = word_entries(routed).orderBy("pos").collect()
    want = [f"w{n}-{i}" for n in range(200) if n % 7 for i in range(n % 4)]
    assert [(r.pos, r.word) for r in rows] == list(enumerate(want))


def test_entries_keep_key_order_and_unknown_keys(spark, tmp_path):
    nameless = '{"response": [{"word": null, "translations": {}}, {"word": "x"}]}'
    routed = route(spark, tmp_path, result("a", AALE), result("b", nameless))
    words = word_entries(routed).withColumn("json", F.to_json("translations"))
    rows = words.orderBy("pos").collect()
    assert [(r.pos, r.word) for r in rows] == [(0, "Aal"), (1, "Ä b"), (2, "x")]
    assert rows[0].json == '{"noun":["eel"],"verb":[],"other":["x"]}'
    assert rows[2].translations is None
    [aside] = quarantine_rows(routed).collect()
    assert (aside.stage, aside.reason) == ("entry", "no word")


def test_entries_are_read_one_by_one(spark, tmp_path):
    """A lone text is a list of it; what can't be read is set aside alone, with its own text."""
    entries = [
        '{"word":"a","translations":{"verb":"x","noun":["y",null],"adverb":null}}',
        '{"word":"b","translations":{"noun":["three"],"verb":5}}',
        '{"word":"c","translations":{"noun":[1]}}',
        '{"word":5,"translations":{"noun":["z"]}}',
        '"text"',
        "null",
        '{"word":"d","translations":["noun"]}',
        '{"word":"e","translations":{"noun":["p"],"noun":["q"]},"word":"f"}',
        '{"translations":{}}',
        '{"word":"g","translations":null}',
    ]
    routed = route(spark, tmp_path, result("1", '{"response":[' + ",".join(entries) + "]}"))
    words = word_entries(routed).orderBy("pos").collect()
    assert [(r.word, r.translations) for r in words] == [
        ("a", {"verb": ["x"], "noun": ["y", None], "adverb": []}), ("f", {"noun": ["q"]}), ("g", None),
    ]
    told = word_entries(routed).orderBy("pos").select(F.to_json("translations")).first()[0]
    assert told.startswith('{"verb":["x"],"noun":["y"')
    aside = {r.line: r.reason for r in quarantine_rows(routed).collect()}
    assert aside == {
        entries[1]: "mistyped entry", entries[2]: "mistyped entry", entries[3]: "mistyped entry", "text": "mistyped entry",
        "null": "mistyped entry", entries[6]: "mistyped entry", entries[8]: "no word",
    }


def test_repeated_members_keep_the_last(spark, tmp_path):
    line = '{"custom_id":"x","custom_id":"y","error":{"a":1,"a":2}}'
    [row] = error_rows(route(spark, tmp_path, line)).collect()
    assert (row.custom_id, row.error) == ("y", '{"a":2}')


def test_error_file(spark, tmp_path):
    (tmp_path / "errors").write_text(
        '{"custom_id":"a","error":{"code":"x"}}\nnull\n{"custom_id": "b" \n'
    )
    routed = stage(route_errors(parse_lines(read_json_lines(spark, str(tmp_path)))))
    [error] = error_rows(routed).collect()
    assert (error.custom_id, error.type) == ("a", "error")
    assert json.loads(error.error) == {"custom_id": "a", "error": {"code": "x"}}
    assert [r.line for r in quarantine_rows(routed).collect()] == ['{"custom_id":"b"']


def test_result_document(spark, tmp_path):
    document = {"results": [result("1", AALE), None, result("2", "{", refusal="no"),
                            result("3", "{")], "errors": [{"custom_id": "4"}, 7]}
    (tmp_path / "one.json").write_text(json.dumps(document, indent=2, ensure_ascii=False))
    documents = stage(read_result_documents(spark, str(tmp_path)))
    results, errors = document_rows(documents, "results"), document_rows(documents, "errors")
    assert unread_documents(documents).count() == 0
    routed = stage(route_results(results))
    rows = routed.orderBy("line_id").collect()
    assert [r.route for r in rows] == ["word", "refusal", "quarantine"]
    assert [r.word for r in word_entries(routed).orderBy("pos").collect()] == ["Aal", "Ä b"]
    errors = error_rows(route_errors(errors)).collect()
    assert [r.custom_id for r in errors] == ["4", None]


def test_documents_that_can_not_be_read(spark, tmp_path):
    texts = {"a": '{"results":[', "b": '{"results":{},"errors":"x"}', "c": "[]", "d": "{}", "e": '{"results":null}', "f": ""}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    documents = stage(read_result_documents(spark, str(tmp_path)))
    found = sorted((r.source_batch[0], r.reason) for r in unread_documents(documents).collect())
    assert found == [
        ("a", "malformed document"), ("b", "errors are no list"), ("b", "results are no list"), ("c", "no document"), ("f", "malformed document"),
    ]
    assert document_rows(documents, "results").count() == 0


def test_many_results(spark, tmp_path):
    lines = [result(f"request-{n}", payload(*[(f"w{n}{i}", {"noun": ["t"]}) for i in range(8)]))
             for n in range(800)]
    routed = route(spark, tmp_path, *lines)
    assert word_entries(routed).count() == 6400
    assert error_rows(routed).count() == 0 and quarantine_rows(routed).count() == 0
