import json
import random

import pytest
from pyspark.sql import functions as F

from wordloom.operators.packing import (
    assign_requests,
    chunk_array,
    chunk_rows,
    pack_words,
    split_valid_word_lists,
    valid_word_lists,
)
from wordloom.operators.requests import batch_sizes, build_requests, oversized_batches
from wordloom.plans.decks import nested_requests, word_list_requests
from wordloom.sources.files import read_languages, read_word_list
from wordloom.sources.sinks import BatchTooLarge, write_requests


def lists_of(packed):
    rows = packed.orderBy("source", "batch_id", "request_id").collect()
    out = {}
    for row in rows:
        batches = out.setdefault(row.source.split("-")[0], [])
        if row.batch_id == len(batches):
            batches.append([])
        assert (row.batch_id, row.request_id) == (len(batches) - 1, len(batches[-1]))
        batches[-1].append(row.words)
    return out


def pack_file(spark, tmp_path, content, **sizes):
    (tmp_path / "list").write_bytes(content)
    return lists_of(word_list_requests(read_word_list(spark, str(tmp_path)), **sizes)).get(
        "list", []
    )


LINES = [f"line{n}" for n in range(1, 11)]


@pytest.mark.parametrize(
    ("content", "sizes", "want"),
    [
        ("\n".join(LINES), {}, [[LINES[:8], LINES[8:]]]),
        ("\n".join(LINES[:4]), {}, [[LINES[:4]]]),
        ("", {}, []),
        ("\n".join(LINES[:5]) + "\n\n\n   \n" + "\n".join(LINES[5:]), {}, [[LINES[:8], LINES[8:]]]),
        ("\r\n".join(LINES) + "\r\n", {"words_per_request": 5}, [[LINES[:5], LINES[5:]]]),
        (" a \n\tb\n", {}, [[[" a ", "\tb"]]]),
        ("\n".join(LINES), {"words_per_request": 2, "requests_per_batch": 2},
         [[LINES[0:2], LINES[2:4]], [LINES[4:6], LINES[6:8]], [LINES[8:10]]]),
    ],
)
def test_word_list_files(spark, tmp_path, content, sizes, want):
    assert pack_file(spark, tmp_path, content.encode(), **sizes) == want


def test_word_list_in_many_blocks(spark, tmp_path):
    words = [f"wort{n}" for n in range(5000)]
    (tmp_path / "list").write_text("\n".join(words))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        read = read_word_list(spark, str(tmp_path))
        assert read.select("block").distinct().count() > 5
        [batch] = lists_of(word_list_requests(read, words_per_request=7)).values()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [w for request in batch[0] for w in request] == words
    assert {len(request) for request in batch[0][:-1]} == {7}


@pytest.mark.parametrize("seed", range(4))
def test_pack_words_against_a_loop(spark, seed):
    rng = random.Random(seed)
    capacity, most = rng.randint(1, 6), rng.randint(1, 5)
    sources = {"x": rng.randint(0, 60), "y": rng.randint(1, 5), "z": capacity * most * 2}
    rows = [(s, k, f"{s}{k}") for s, n in sources.items() for k in rng.sample(range(999), n)]
    df = spark.createDataFrame(rows, "source STRING, k INT, word STRING").repartition(seed + 1)
    got = lists_of(pack_words(df, ["k"], words_per_request=capacity, requests_per_batch=most))
    for source in sources:
        words = [w for s, k, w in sorted(rows) if s == source]
        requests = [words[i:i + capacity] for i in range(0, len(words), capacity)]
        want = [requests[i:i + most] for i in range(0, len(requests), most)]
        assert got.get(source, []) == want


def test_sizes_below_one_are_refused(spark):
    df = spark.range(3).withColumnRenamed("id", "pos")
    with pytest.raises(ValueError):
        assign_requests(df, words_per_request=0)
    with pytest.raises(ValueError):
        assign_requests(df, requests_per_batch=0)


def test_chunks(spark):
    df = spark.range(11).select("id", (F.col("id") % 2).alias("g"))
    rows = chunk_rows(df, "id", 4, ["id"], ["g"]).orderBy("g", "chunk_id").collect()
    assert [r["items"] for r in rows] == [[0, 2, 4, 6], [8, 10], [1, 3, 5, 7], [9]]
    lists = spark.createDataFrame([([1, 2, 3, 4, 5],), ([],), ([1, 2],)], "a ARRAY<INT>")
    got = [r[0] for r in lists.select(chunk_array(F.col("a"), 2)).collect()]
    assert got == [[[1, 2], [3, 4], [5]], [], [[1, 2]]]


def test_valid_word_lists(spark):
    cases = [
        ([["a", "b"], ["c", "d"]], True), ([], False), ([[]], False), ([["a"], []], False),
        ([[" "]], False), ([["a", None]], False), ([["a"], None], False), (None, False),
        ([["\u00a0"]], False), ([["-"]], True),
    ]
    df = spark.createDataFrame([(c, w) for c, w in cases],
                               "word_list ARRAY<ARRAY<STRING>>, want BOOLEAN")
    assert df.filter(valid_word_lists(F.col("word_list")) != F.col("want")).count() == 0
    good, bad = split_valid_word_lists(df)
    assert (good.count(), bad.count()) == (2, 8)


@pytest.fixture
def packed(spark):
    return spark.createDataFrame(
        [("s", 0, 0, ["Haus", "Tür"]), ("s", 0, 1, ['"x"']), ("s", 1, 0, ["Ende"])],
        "source STRING, batch_id BIGINT, request_id BIGINT, words ARRAY<STRING>",
    )


def test_plain_requests(packed):
    rows = build_requests(packed, user_prefix="Say: ", system_message="sys", model="m",
                          max_tokens=12.9).orderBy("batch_id", "request_id").collect()
    assert [r.custom_id for r in rows] == ["request-1", "request-2", "request-1"]
    assert json.loads(rows[0].line) == {
        "custom_id": "request-1", "method": "POST", "url": "/v1/chat/completions",
        "body": {
            "model": "m",
            "messages": [
                {"role": "system", "content": "sys"},
                {"role": "user", "content": "Say: Haus, Tür"},
            ],
            "max_tokens": 12,
        },
    }
    assert json.loads(rows[1].line)["body"]["messages"][1]["content"] == 'Say: "x"'
    # Members keep their order and non-ASCII letters are not escaped.
    assert rows[0].line.startswith('{"custom_id":"request-1","method":"POST"')
    assert "Tür" in rows[0].line


def test_structured_requests(packed):
    schema = {"type": "object", "properties": {"b": {}, "a": {}}, "required": ["b"]}
    rows = build_requests(packed, "structured", "Say: ", "sys", answer_schema=schema,
                          answer_name="words").orderBy("batch_id", "request_id").collect()
    assert [r.custom_id for r in rows] == ["request-0", "request-1", "request-0"]
    body = json.loads(rows[0].line)["body"]
    assert body["messages"][1]["content"] == "Say: Haus Tür"
    assert body["response_format"] == {
        "type": "json_schema",
        "json_schema": {"name": "words", "strict": True, "schema": schema},
    }
    assert list(body["response_format"]["json_schema"]["schema"]["properties"]) == ["b", "a"]
    default = json.loads(build_requests(packed, "structured").first().line)
    assert default["body"]["max_tokens"] == 1152
    entry = default["body"]["response_format"]["json_schema"]["schema"]["properties"]["response"]
    assert len(entry["items"]["properties"]["translations"]["properties"]) == 10
    with pytest.raises(ValueError):
        build_requests(packed, "other")


def test_request_files(spark, packed, tmp_path):
    requests = build_requests(packed)
    out = tmp_path / "out"
    write_requests(requests, str(out))
    files = sorted(out.glob("source=s/batch_id=*/*.txt"))
    assert len(files) == 2
    lines = files[0].read_text().splitlines()
    want = [r.line for r in requests.filter("batch_id = 0").orderBy("request_id").collect()]
    assert lines == want
    size = {r.batch_id: (r.n_lines, r.n_bytes) for r in batch_sizes(requests).collect()}
    assert size[0] == (2, files[0].stat().st_size)


def test_request_limits(spark, packed, tmp_path):
    requests = build_requests(packed)
    with pytest.raises(BatchTooLarge):
        write_requests(requests, str(tmp_path / "a"), max_lines=1)
    with pytest.raises(BatchTooLarge):
        write_requests(requests, str(tmp_path / "b"), max_bytes=100)
    assert not (tmp_path / "a").exists() and not (tmp_path / "b").exists()
    size = {r.batch_id: r.n_bytes for r in batch_sizes(requests).collect()}
    assert oversized_batches(requests, max_bytes=max(size.values())).count() == 0
    assert oversized_batches(requests, max_bytes=max(size.values()) - 1).count() == 1


def test_languages_from_a_list(spark, tmp_path):
    (tmp_path / "languages.txt").write_text("English\n  German \n\n \nCzech\r\n")
    rows = read_languages(spark, str(tmp_path)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "English"), (2, "German"), (3, "Czech")]


def test_nested_lists_become_requests(spark):
    rows = [(1, [["eins", "zwei"], ["drei"]]), (2, []), (3, [["vier", " "]]), (4, [[]]), (5, None)]
    lists = spark.createDataFrame(rows, "id LONG, word_list ARRAY<ARRAY<STRING>>")
    lines, refused = nested_requests(lists, ["id"], system_message="sys")
    found = lines.orderBy("request_id").collect()
    assert [(r.id, r.batch_id, r.request_id, r.custom_id, r.user_message) for r in found] == [
        (1, 0, 0, "request-0", "Translate the following words: eins zwei"),
        (1, 0, 1, "request-1", "Translate the following words: drei"),
    ]
    assert all("response_format" in json.loads(r.line)["body"] for r in found)
    assert sorted(r.id for r in refused.collect()) == [2, 3, 4, 5]
    plain, _ = nested_requests(lists, ["id"], mode="plain")
    assert plain.orderBy("request_id").first().user_message.endswith("eins, zwei")
