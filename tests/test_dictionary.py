import json
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_enrich import entries, entry_frame
from test_results import AALE, payload, result

from wordloom.operators.enrich import process_words
from wordloom.operators.results import parse_lines
from wordloom.plans.dictionary import (
    CHILD_TABLES,
    UnknownCategory,
    UnknownLanguage,
    dictionary_check,
    save_audit,
    save_dictionary,
    save_languages,
    seed_languages,
    word_differences,
)
from wordloom.plans.ingest import ingest_documents, ingest_errors, ingest_results, result_words
from wordloom.schemas import LANGUAGES, TABLES
from wordloom.session import folder_names, shared_folder, stage
from wordloom.sources import sinks
from wordloom.sources.files import document_rows, list_sources, read_json_lines, read_result_documents
from wordloom.sources.sinks import last_ids, read_table
from wordloom.streaming.ingest import start_ingest

TABLE_NAMES = ("word", *CHILD_TABLES)


def content(spark, root):
    return {name: sorted(tuple(r) for r in read_table(spark, root, name).collect())
            for name in TABLE_NAMES}


def by_word(spark, root, table, column):
    words = read_table(spark, root, "word").select(F.col("id").alias("word_id"), "word")
    rows = read_table(spark, root, table).join(words, "word_id").orderBy("id").collect()
    return [(r.word, r[column]) for r in rows]


@pytest.fixture
def sample(spark):
    return process_words(entries(
        spark,
        ("Aachenerin", {"noun": ["female native of Aachen"]}),
        ("Aachener", {"noun": ["native of Aachen", "resident"], "adjective": ["Aachen"],
                      "verb": []}),
        ("Aachen", {"noun": ["Aachen"]}),
        ("zwiebeln", {"verb": ["go", "walk"]}),
    ))


def test_save(spark, sample, tmp_path):
    root = str(tmp_path)
    save_dictionary(sample, root)
    got = content(spark, root)
    assert got["word"] == [(1, "Aachener", 12), (2, "Aachenerin", 12), (3, "zwiebeln", 12)]
    assert got["translation"] == [
        (1, 2, "noun", "female native of Aachen", 12, 1, "b"),
        (2, 1, "noun", "native of Aachen", 12, 1, "b"),
        (3, 1, "noun", "resident", 12, 1, "b"),
        (4, 1, "adjective", "Aachen", 12, 1, "b"),
        (5, 3, "verb", "go", 12, 1, "b"),
        (6, 3, "verb", "walk", 12, 1, "b"),
    ]
    assert got["similar_word"] == [
        (1, 2, "Aachener", 12, "b"), (2, 1, "Aachenerin", 12, "b"), (3, 1, "Aachen", 12, "b"),
    ]
    assert [row[2] for row in got["grammar_category"]] == ["noun", "noun", "adjective", "verb"]
    audit = save_audit(spark, sample, root).collect()
    assert len(audit) == 4 and all(r.expected == r.stored for r in audit)
    assert word_differences(sample, read_table(spark, root, "word")).count() == 0


def test_saving_again_changes_nothing_but_child_ids(spark, sample, tmp_path):
    root = str(tmp_path)
    save_dictionary(sample, root)
    before = content(spark, root)
    save_dictionary(sample, root)
    after = content(spark, root)
    assert after["word"] == before["word"]
    for table in CHILD_TABLES:
        assert [row[1:] for row in after[table]] == [row[1:] for row in before[table]]


def test_ids_go_on_without_reading_the_tables(spark, sample, tmp_path):
    root = str(tmp_path)
    assert last_ids(spark, root, TABLE_NAMES) == dict.fromkeys(TABLE_NAMES, 0)
    save_dictionary(sample, root)
    last = {"word": 3, "translation": 6, "similar_word": 3, "grammar_category": 4}
    assert last_ids(spark, root, TABLE_NAMES) == last
    save_dictionary(sample, root)
    assert last_ids(spark, root, TABLE_NAMES) == {
        "word": 3, "translation": 12, "similar_word": 6, "grammar_category": 8}
    ids = [r.id for r in read_table(spark, root, "translation").orderBy("id").collect()]
    assert ids == list(range(7, 13))
    # Without a counter the table itself tells.
    other = str(tmp_path / "other")
    sinks.append_rows(read_table(spark, root, "word"), other, "word")
    assert last_ids(spark, other, ("word", "translation")) == {"word": 3, "translation": 0}


def test_emptied_batches_lose_their_rows(spark, sample, tmp_path):
    root = str(tmp_path)
    save_dictionary(sample, root)
    save_dictionary(sample.withColumn("source_batch", F.lit("c")), root)
    names = spark.createDataFrame([("c",), ("never seen",)], "source_batch STRING")
    save_dictionary(sample.limit(0), root, batches=names)
    left = read_table(spark, root, "grammar_category").select("source_batch").distinct().collect()
    assert [r[0] for r in left] == ["b"]


def test_the_audit_counts_its_own_run(spark, sample, tmp_path):
    root = str(tmp_path)
    other = process_words(entries(spark, ("neu", {"adjective": ["new"]}), ("Aachener", {"noun": ["x"]}), batch="c"))
    for rows in (sample, other, sample):
        save_dictionary(rows, root)
    for rows, words in ((sample, 3), (other, 2)):
        audit = {r.table_name: (r.expected, r.stored) for r in save_audit(spark, rows, root).collect()}
        assert audit["word"] == (words, words) and all(x == y for x, y in audit.values())


def staged(spark):
    return set(folder_names(spark, shared_folder(spark)))


def test_saves_leave_nothing_staged_and_list_little(spark, sample, tmp_path):
    root, before = str(tmp_path), None
    stages = staged(spark)
    for n in range(6):
        save_dictionary(sample.withColumn("source_batch", F.lit(f"batch-{n}")), root)
        assert len(list((tmp_path / "id_counter").iterdir())) == 1
        words = list((tmp_path / "word").rglob("*.parquet"))
        before = before or len(words)
        assert len(words) <= before + n  # a new word needs a file, a known one does not
    assert staged(spark) == stages
    assert read_table(spark, root, "translation").count() == 36


def test_languages_are_stored_and_checked(spark, sample, tmp_path):
    root = str(tmp_path)
    with pytest.raises(UnknownLanguage):
        save_dictionary(sample, root, primary_language=45)
    names = spark.createDataFrame([(1, "English"), (2, "German")], "id INT, name STRING")
    for _ in range(2):
        save_languages(names, root)
    more = spark.createDataFrame([(1, "German"), (2, "Dutch")], "id INT, name STRING")
    save_languages(more, root)
    assert sorted(map(tuple, read_table(spark, root, "language").collect())) == [(1, "English"), (2, "German"), (3, "Dutch")]
    with pytest.raises(UnknownLanguage, match="12"):
        save_dictionary(sample, root)
    save_dictionary(sample, root, primary_language=2, secondary_language=3)
    assert dictionary_check(spark, root).count() == 0
    sinks.append_rows(spark.createDataFrame([(9, "Aachener", 2), (9, None, 7)], TABLES["word"]), root, "word")
    found = {(r.table_name, r.problem, r.column, r.value, r.n_rows) for r in dictionary_check(spark, root).collect()}
    assert found == {
        ("word", "orphan", "primary_language", "7", 1), ("word", "duplicate", "id", "9", 2),
        ("word", "duplicate", "word,primary_language", "Aachener", 2), ("word", "null", "", "word", 1),
    }


def test_batches_share_words_and_keep_their_rows(spark, sample, tmp_path):
    root = str(tmp_path)
    save_dictionary(sample, root)
    other = process_words(entries(
        spark, ("zwiebeln", {"verb": ["go"]}), ("neu", {"adjective": ["new"]}), batch="second/ä b",
    ))
    save_dictionary(other, root)
    words = {r.word: r.id for r in read_table(spark, root, "word").collect()}
    assert words == {"Aachener": 1, "Aachenerin": 2, "zwiebeln": 3, "neu": 4}
    assert read_table(spark, root, "translation").count() == 8
    for table in CHILD_TABLES:
        ids = [r.id for r in read_table(spark, root, table).collect()]
        assert len(ids) == len(set(ids))
    # The second batch comes again without rows: its old rows go, the others stay.
    names = spark.createDataFrame([("second/ä b",)], "source_batch STRING")
    save_dictionary(other.limit(0), root, batches=names)
    assert {r.source_batch for r in read_table(spark, root, "translation").collect()} == {"b"}
    assert read_table(spark, root, "translation").count() == 6
    assert read_table(spark, root, "word").count() == 4


def test_languages_are_apart(spark, sample, tmp_path):
    root = str(tmp_path)
    save_dictionary(sample, root)
    save_dictionary(sample, root, primary_language=26)
    rows = read_table(spark, root, "word").collect()
    assert len(rows) == 6 and len({r.id for r in rows}) == 6
    assert read_table(spark, root, "translation").filter("primary_language = 12").count() == 6
    # An emptied batch goes in its own language only.
    names = spark.createDataFrame([("b",)], "source_batch STRING")
    save_dictionary(sample.limit(0), root, primary_language=26, batches=names)
    left = read_table(spark, root, "translation").select("primary_language").distinct().collect()
    assert [r[0] for r in left] == [12]


def test_same_word_twice_is_stored_once(spark, tmp_path):
    root = str(tmp_path)
    twice = process_words(entries(spark, ("ja", {"adverb": ["yes"]}), ("ja", {"noun": ["aye"]})))
    save_dictionary(twice, root)
    assert read_table(spark, root, "word").count() == 1
    assert by_word(spark, root, "translation", "translation") == [("ja", "yes"), ("ja", "aye")]
    assert by_word(spark, root, "similar_word", "similar_word") == [("ja", "ja"), ("ja", "ja")]
    rows = word_differences(twice, read_table(spark, root, "word")).collect()
    assert [tuple(r) for r in rows] == [("ja", "duplicate")]


def test_unknown_category_fails_before_writing(spark, tmp_path):
    root = str(tmp_path / "new")
    strange = process_words(entries(spark, ("a", {"noun": ["x"]}), ("b", {"Noun": []}),
                                    ("c", {"noun": ["z"], "odd": []})))
    with pytest.raises(UnknownCategory, match="odd"):
        save_dictionary(strange, root)
    assert not (tmp_path / "new").exists()


def test_word_differences(spark, sample):
    stored = spark.createDataFrame([("Aachener",), ("extra",)], "word STRING")
    rows = {tuple(r) for r in word_differences(sample, stored).collect()}
    assert rows == {("Aachenerin", "missing"), ("zwiebeln", "missing"), ("extra", "extra")}


def test_seed_languages(spark):
    names = spark.createDataFrame(list(enumerate(LANGUAGES, 1)), "id INT, name STRING")
    none = spark.createDataFrame([], TABLES["language"])
    first = seed_languages(names, none)
    assert sorted(map(tuple, first.collect())) == list(enumerate(LANGUAGES, 1))
    assert LANGUAGES[11] == "German" and len(LANGUAGES) == 44
    some = spark.createDataFrame([(1, "English"), (5, "German")], TABLES["language"])
    rows = {r.name: r.id for r in seed_languages(names, some).collect()}
    assert len(rows) == 42 and rows["Mandarin"] == 6 and rows["Icelandic"] == 47


def write_lines(path, *lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


ANSWER = payload(("Haus", {"noun": ["house"]}), ("Maus", {"noun": ["mouse"], "verb": []}))


def check_ingested(spark, root):
    assert by_word(spark, root, "translation", "translation") == [
        ("Haus", "house"), ("Maus", "mouse"), ("Tag", "day"),
    ]
    # Similar words never cross files.
    assert by_word(spark, root, "similar_word", "similar_word") == [
        ("Haus", "Maus"), ("Maus", "Haus"),
    ]
    errors = {(r.custom_id, r.type) for r in read_table(spark, root, "error").collect()}
    assert errors == {("3", "error"), ("4", "refusal")}
    assert [r.line for r in read_table(spark, root, "quarantine").collect()] == ["{x"]


def write_results(folder):
    folder.mkdir(exist_ok=True)
    write_lines(folder / "a.jsonl", result("1", ANSWER), "{ x", result("3", error={"m": 1}))
    write_lines(folder / "b.jsonl", result("4", refusal="no"),
                result("5", payload(("Tag", {"noun": ["day"]}))))


def test_ingest_and_again(spark, tmp_path):
    root = str(tmp_path / "root")
    write_results(tmp_path / "in")
    for _ in range(2):
        ingest_results(read_json_lines(spark, str(tmp_path / "in")), root)
        check_ingested(spark, root)


def test_ingest_replaces_a_corrected_file(spark, tmp_path):
    root = str(tmp_path / "root")
    write_results(tmp_path / "in")
    ingest_results(read_json_lines(spark, str(tmp_path / "in")), root)
    write_lines(tmp_path / "in" / "a.jsonl", result("1", '{"response": []}'))
    ingest_results(read_json_lines(spark, str(tmp_path / "in")), root)
    assert by_word(spark, root, "translation", "translation") == [("Tag", "day")]
    assert read_table(spark, root, "similar_word").count() == 0
    assert read_table(spark, root, "quarantine").count() == 0
    assert [r.custom_id for r in read_table(spark, root, "error").collect()] == ["4"]


def errors_of(spark, root):
    return sorted((r.custom_id or "", r.origin) for r in read_table(spark, root, "error").collect())


def write_document(folder, results, errors, name="doc.json"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps({"results": results, "errors": errors}))


def test_ingest_documents(spark, tmp_path):
    root, folder = str(tmp_path / "root"), tmp_path / "in"
    write_document(folder, [result("1", ANSWER), result("2", error="late"), result("3", "{")], [{"custom_id": "9"}, None])
    (folder / "bad.json").write_text('{"results": [')
    for _ in range(2):
        ingest_documents(read_result_documents(spark, str(folder)), root)
        assert by_word(spark, root, "translation", "translation") == [("Haus", "house"), ("Maus", "mouse")]
        assert errors_of(spark, root) == [("2", "result"), ("9", "error")]
        aside = sorted((r.stage, r.reason) for r in read_table(spark, root, "quarantine").collect())
        assert aside == [("content", "malformed content"), ("document", "malformed document")]
    # A document that can't be read any more replaces what its file stored.
    (folder / "doc.json").write_text("")
    ingest_documents(read_result_documents(spark, str(folder)), root)
    assert read_table(spark, root, "translation").count() == 0 and errors_of(spark, root) == []
    assert [r.reason for r in read_table(spark, root, "quarantine").collect()] == ["malformed document"] * 2


@pytest.mark.parametrize("errors_first", [True, False])
def test_results_and_errors_of_one_source_stay_apart(spark, tmp_path, errors_first):
    root, folder = str(tmp_path / "root"), tmp_path / "in"
    write_document(folder, [result("2", error="late"), result("3", "{")], [{"custom_id": "9"}])
    documents = stage(read_result_documents(spark, str(folder)))
    steps = [
        lambda: ingest_results(document_rows(documents, "results"), root),
        lambda: ingest_errors(document_rows(documents, "errors"), root),
    ]
    for step in reversed(steps) if errors_first else steps:
        step()
    assert errors_of(spark, root) == [("2", "result"), ("9", "error")]
    assert read_table(spark, root, "quarantine").count() == 1


@pytest.mark.parametrize("left", ["", "null\n", "\n"])
def test_an_emptied_file_loses_its_rows(spark, tmp_path, left):
    root, folder = str(tmp_path / "root"), tmp_path / "in"
    write_results(folder)
    ingest_results(read_json_lines(spark, str(folder)), root)
    (folder / "a.jsonl").write_text(left)
    ingest_results(read_json_lines(spark, str(folder)), root, batches=list_sources(spark, str(folder)))
    assert by_word(spark, root, "translation", "translation") == [("Tag", "day")]
    assert errors_of(spark, root) == [("4", "result")] and read_table(spark, root, "quarantine").count() == 0


def test_result_words_store_nothing(spark, tmp_path):
    write_results(tmp_path / "in")
    words = result_words(read_json_lines(spark, str(tmp_path / "in")))
    assert sorted(r.word for r in words.processed.collect()) == ["Haus", "Maus", "Tag"]
    assert (words.errors.count(), words.aside.count()) == (2, 1)


def test_ingest_unknown_category(spark, tmp_path):
    root = str(tmp_path / "root")
    (tmp_path / "in").mkdir()
    write_lines(tmp_path / "in" / "a", result("1", ANSWER), result("2", AALE))
    lines = read_json_lines(spark, str(tmp_path / "in"))
    with pytest.raises(UnknownCategory):
        ingest_results(lines, root)
    ingest_results(lines, root, unknown_categories="quarantine")
    words = {r.word for r in read_table(spark, root, "word").collect()}
    assert words == {"Haus", "Maus", "Ä b"}
    [aside] = read_table(spark, root, "quarantine").collect()
    assert (aside.stage, json.loads(aside.line)["word"]) == ("category", "Aal")


def test_stream_ingest(spark, tmp_path):
    root, checkpoint = str(tmp_path / "root"), str(tmp_path / "checkpoint")
    write_results(tmp_path / "in")
    # One file per micro-batch, then a restart that finds nothing new.
    for _ in range(2):
        query = start_ingest(spark, str(tmp_path / "in"), root, checkpoint, files_per_batch=1)
        assert query.awaitTermination(120)
        assert query.exception() is None
        rows = sorted(by_word(spark, root, "translation", "translation"))
        assert rows == [("Haus", "house"), ("Maus", "mouse"), ("Tag", "day")]
    # A lost checkpoint gives every file again.
    query = start_ingest(spark, str(tmp_path / "in"), root, checkpoint + "2")
    assert query.awaitTermination(120)
    assert read_table(spark, root, "translation").count() == 3
    write_lines(tmp_path / "in" / "c.jsonl", result("1", payload(("Nacht", {"noun": ["night"]}))))
    query = start_ingest(spark, str(tmp_path / "in"), root, checkpoint)
    assert query.awaitTermination(120)
    assert read_table(spark, root, "translation").count() == 4


def test_a_stream_clears_what_an_emptied_file_stored(spark, tmp_path):
    root, folder = str(tmp_path / "root"), tmp_path / "in"
    write_results(folder)
    query = start_ingest(spark, str(folder), root, str(tmp_path / "one"))
    assert query.awaitTermination(120) and read_table(spark, root, "translation").count() == 3
    stored = {r.source_batch for r in read_table(spark, root, "translation").collect()}
    emptied = next(f for f in sorted(folder.iterdir()) if any(b.startswith(f.name + "-") for b in stored))
    emptied.write_bytes(b"")
    query = start_ingest(spark, str(folder), root, str(tmp_path / "two"), files_per_batch=1)
    assert query.awaitTermination(120) and query.exception() is None
    left = {r.source_batch for r in read_table(spark, root, "translation").collect()}
    assert left == {b for b in stored if not b.startswith(emptied.name + "-")}


def test_one_bad_file_does_not_stop_the_stream(spark, tmp_path):
    root = str(tmp_path / "root")
    write_results(tmp_path / "in")
    write_lines(tmp_path / "in" / "odd.jsonl", result("1", AALE), "not json", "[1")
    for checkpoint in ("c1", "c2"):
        query = start_ingest(spark, str(tmp_path / "in"), root, str(tmp_path / checkpoint))
        assert query.awaitTermination(120) and query.exception() is None
        rows = sorted(by_word(spark, root, "translation", "translation"))
        assert rows == [("Haus", "house"), ("Maus", "mouse"), ("Tag", "day"), ("Ä b", "a b")]
        reasons = sorted(r.reason for r in read_table(spark, root, "quarantine").collect())
        assert reasons == ["malformed line"] * 3 + ["unknown category"]


def test_stream_error_files(spark, tmp_path):
    root = str(tmp_path / "root")
    (tmp_path / "in").mkdir()
    write_lines(tmp_path / "in" / "e.jsonl", {"custom_id": "1", "error": {"code": "x"}}, "{ bad")
    query = start_ingest(spark, str(tmp_path / "in"), root, str(tmp_path / "c"), kind="errors")
    assert query.awaitTermination(120)
    assert [r.type for r in read_table(spark, root, "error").collect()] == ["error"]
    assert [r.stage for r in read_table(spark, root, "quarantine").collect()] == ["error file"]


def test_hot_word_over_many_batches(spark, tmp_path, monkeypatch):
    import wordloom.operators.lookups as lookups

    monkeypatch.setattr(lookups.lookup_join, "__defaults__", (5, lookups.BROADCAST_BYTES))
    rows = [(f"b{n % 4}", n, "ja" if n % 3 else f"w{n}", {"adverb": [f"t{n}"]})
            for n in range(60)]
    processed = process_words(entry_frame(spark, rows), neighbours=0)
    save_dictionary(processed, str(tmp_path))
    got = by_word(spark, str(tmp_path), "translation", "translation")
    assert sorted(got) == sorted((w, t["adverb"][0]) for _, _, w, t in rows)


def test_a_save_stages_no_list_of_similar_words(spark, tmp_path, monkeypatch):
    """A list holds up to a hundred whole words; each is a row of its own (F1)."""
    from wordloom.plans import dictionary

    staged = []
    kept = dictionary.stage
    monkeypatch.setattr(dictionary, "stage", lambda df, *given, **more: (staged.append(df.columns), kept(df, *given, **more))[1])
    rows = spark.createDataFrame(
        [("b", 0, "w0", {"noun": ["x"]}, ["w1", "w2"], ["noun"]), ("b", 1, "w1", {"verb": ["y", "z"]}, [], ["verb"]), ("c", 0, "w2", {"noun": ["x"]}, ["w0"], ["noun"])],
        "source_batch STRING, pos BIGINT, word STRING, translations MAP<STRING, ARRAY<STRING>>, similar_words ARRAY<STRING>, grammar_categories ARRAY<STRING>",
    )
    root = str(tmp_path / "d")
    for _ in range(2):
        dictionary.save_dictionary(rows, root)
    assert staged and not [names for names in staged if "similar_words" in names]
    found = dictionary.read_table(spark, root, "similar_word").orderBy("source_batch", "id").collect()
    assert [(row.source_batch, row.word_id, row.similar_word) for row in found] == [("b", 1, "w1"), ("b", 1, "w2"), ("c", 3, "w0")]
    assert len({row.id for row in found}) == 3


def test_folders_of_small_batches_are_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(60).select(
        "id", F.lit(1).cast("bigint").alias("word_id"), F.lit("noun").alias("category"), F.concat(F.lit("b"), F.col("id").cast("string")).alias("source_batch")
    )
    sinks.replace_batches(rows, str(tmp_path), "grammar_category", rows, primary_language=12, secondary_language=1)
    tasks = {file.name.split("-")[1] for file in tmp_path.glob("grammar_category/**/*.parquet")}
    assert len(tasks) > 1 and read_table(spark, str(tmp_path), "grammar_category").count() == 60


def test_long_similar_words_are_stored_without_their_copies(spark, tmp_path):
    """Words of a language may all be similar: each text is sent once, its copies take little room (F2)."""
    rng = random.Random(2)
    words = [("b" if at % 3 else "c", "".join(rng.choice("abcdefgh ") for _ in range(9000))) for at in range(150)]
    rows, places = [], {}
    for batch, word in words:
        places[batch] = places.get(batch, -1) + 1
        # The last is not translated: it is found, and finds nothing.
        rows.append((batch, places[batch], word, {"noun": ["en"]} if len(rows) < 149 else {}))
    rows += [(None, at, f"alone{at}", {"noun": ["en"]}) for at in range(3)]
    told = stage(entry_frame(spark, rows))
    roots = {name: str(tmp_path / name) for name in ("lists", "steps")}
    save_dictionary(process_words(told), roots["lists"])
    steps = process_words(told, as_steps=True)
    empty = spark.createDataFrame([("b",), ("c",), ("gone",)], "source_batch STRING")
    for _ in range(2):
        save_dictionary(steps, roots["steps"], batches=empty, entries=told)
    last = {name: max(row[0] for row in read_table(spark, roots["lists"], name).select("id").collect()) for name in CHILD_TABLES}
    lists, kept = content(spark, roots["lists"]), content(spark, roots["steps"])
    # The second save took the next ids.
    assert lists == {name: [(row[0] - last.get(name, 0), *row[1:]) for row in rows] for name, rows in kept.items()}
    stored = sum(file.stat().st_size for file in tmp_path.glob("steps/similar_word/**/*.parquet"))
    assert len(kept["similar_word"]) > 8000 and stored < 3 * 150 * 9000
    assert (tmp_path / "steps/similar_word/primary_language=12/source_batch=gone").exists()


def test_similar_texts_are_not_sorted_with_their_rows(spark, tmp_path, monkeypatch):
    """Behind the exchange rows and texts are sorted once, before they meet (F2)."""
    kinds = "source_batch STRING, pos BIGINT"
    rows = spark.createDataFrame([("b", 1, 7, 3), (None, 0, 8, 4)], f"{kinds}, id BIGINT, word_id BIGINT")
    texts = spark.createDataFrame([("b", 1, "x"), ("b", 2, "y"), (None, 0, "z")], f"{kinds}, similar_word STRING")
    plans, write = [], sinks._write_batches
    monkeypatch.setattr(sinks, "_write_batches", lambda made, *given, **more: (plans.append(made), write(made, *given, **more)))
    sinks.replace_batches(rows, str(tmp_path), "similar_word", rows, texts, primary_language=12)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ordering = plans[0].select("*")._jdf.queryExecution().executedPlan().outputOrdering()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    ordered = [ordering.apply(i).toString() for i in range(2)]
    assert ordered[0].startswith("primary_language") and ordered[1].startswith("source_batch") and not plans[0].schema["source_batch"].nullable
    got = sorted([tuple(row) for row in read_table(spark, str(tmp_path), "similar_word").collect()], key=str)
    assert got == [(7, 3, "x", 12, "b"), (8, 4, "z", 12, None)]


def test_long_documents_are_staged_in_small_row_groups(spark, tmp_path, monkeypatch):
    """A reader takes a row group's documents into memory together (F3)."""
    from wordloom.plans import ingest

    paths, kept = {}, ingest.stage
    monkeypatch.setattr(ingest, "stage", lambda df, label, *given, **more: paths.setdefault(label, kept(df, label, *given, **more)))
    seen = {}
    write = ingest.replace_batches

    def looked(*given, **more):
        for label, staged in paths.items():
            files = [name.removeprefix("file:") for name in staged.inputFiles()]
            seen[label] = max((pq.ParquetFile(name).metadata.row_group(i).num_rows for name in files for i in range(pq.ParquetFile(name).num_row_groups)), default=0)
        return write(*given, **more)

    monkeypatch.setattr(ingest, "replace_batches", looked)
    text = json.dumps({"results": [result("r", payload(("Aal", {"noun": ["eel"]})))], "errors": [], "rest": ["x" * 50] * 8000})
    documents = spark.range(0, 90, 1, 1).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("source"), F.lit(text).alias("raw"))
    ingest_documents(parse_lines(documents, "raw"), str(tmp_path))
    assert 0 < seen["documents"] < 60
    assert read_table(spark, str(tmp_path), "word").count() == 1
    assert read_table(spark, str(tmp_path), "translation").select("source_batch").distinct().count() == 90
