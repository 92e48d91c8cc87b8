import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordloom.catalog import inputs
from wordloom.functions.words import filled_categories, require_category
from wordloom.operators import alike
from wordloom.operators.checks import split_by_category
from wordloom.operators.enrich import _alike, _sketched, drop_untranslated, process_words
from wordloom.schemas import TRANSLATIONS

def entry_frame(spark, rows):
    """Rows of (batch, pos, word, translations); by way of JSON, which keeps the key order."""
    texts = [(batch, pos, word, json.dumps(each)) for batch, pos, word, each in rows]
    df = spark.createDataFrame(texts, "source_batch STRING, pos BIGINT, word STRING, j STRING")
    translations = F.from_json("j", TRANSLATIONS).alias("translations")
    return df.select("source_batch", "pos", "word", translations)


def entries(spark, *words, batch="b"):
    return entry_frame(spark, [(batch, pos, word, each) for pos, (word, each) in enumerate(words)])


def processed(df, **options):
    return process_words(df, **options).orderBy("source_batch", "pos").collect()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def by_hand(words, distance, neighbours):
    flat = [[t for each in (m or {}).values() for t in (each or [])] for _, m in words]
    out = []
    for at, (word, _) in enumerate(words):
        if all(t == word for t in flat[at]):
            continue
        similar = []
        for other in range(max(0, at - neighbours), min(len(words), at + neighbours + 1)):
            pairs = [(word, words[other][0])] + [(a, b) for a in flat[at] for b in flat[other]]
            if other != at and any(
                edit_distance(a.lower(), b.lower()) <= distance for a, b in pairs
            ):
                similar.append(words[other][0])
        out.append((at, word, similar))
    return out


def test_similar_by_spelling(spark):
    rows = processed(entries(
        spark,
        ("Aachenerin", {"noun": ["female native of Aachen"]}),
        ("Aachener", {"noun": ["native of Aachen"]}),
    ))
    assert [r.similar_words for r in rows] == [["Aachener"], ["Aachenerin"]]


def test_similar_by_translation_only(spark):
    far = entries(spark, ("aalähnlich", {"adjective": ["asdasddas"]}),
                  ("aalartig", {"adjective": ["ggfd"]}))
    near = entries(spark, ("aalähnlich", {"adjective": ["eel-like", "similar to an eel"]}),
                   ("aalartig", {"adjective": ["eel-like"]}))
    assert [r.similar_words for r in processed(far)] == [[], []]
    assert [r.similar_words for r in processed(near)] == [["aalartig"], ["aalähnlich"]]


def test_dropped_words_are_still_found(spark):
    df = entries(
        spark,
        ("Aachenerin", {"noun": ["female native of Aachen"]}),
        ("Aachen", {"noun": ["Aachen"], "verb": None}),
        ("Aachem", {"noun": [], "verb": []}),
        ("aachen", {"noun": ["Aachen"]}),
        ("nichts", None),
    )
    rows = processed(df)
    assert [(r.word, r.similar_words) for r in rows] == [
        ("Aachenerin", []), ("aachen", ["Aachen", "Aachem"]),
    ]
    assert {r.word for r in drop_untranslated(df).collect()} == {"Aachenerin", "aachen"}


def test_same_word_twice_and_frame_edges(spark):
    words = [("ja", {"adverb": ["yes"]})] + [
        (f"zzzzzzzzzz{n}{n}{n}{n}{n}", {"noun": [f"qqqqqqq{n}{n}{n}{n}{n}"]}) for n in range(3)
    ] + [("ja", {"adverb": ["yes"]})]
    at_edge = processed(entries(spark, *words), neighbours=4)
    beyond = processed(entries(spark, *words), neighbours=3)
    alone = processed(entries(spark, *words), neighbours=0)
    assert at_edge[0].similar_words == ["ja"] == at_edge[-1].similar_words
    assert beyond[0].similar_words == [] and alone[0].similar_words == []
    assert len(alone) == 5


def test_categories_in_entry_order(spark):
    rows = processed(entries(spark, ("Aachener", {
        "verb": [], "noun": ["native of Aachen", "resident"], "adjective": ["Aachen"],
        "adverb": [], "pronoun": None, "strange": ["x"],
    })))
    assert rows[0].grammar_categories == ["noun", "adjective", "strange"]


@pytest.mark.parametrize("seed", range(6))
def test_against_a_loop(spark, seed):
    rng = random.Random(seed)
    distance, neighbours = rng.randint(0, 3), rng.choice([1, 2, 3, 7, 50])

    def spelling(longest):
        return "".join(rng.choice("abÄß") for _ in range(rng.randint(0, longest)))

    sequences = {
        name: [
            (spelling(6), {kind: [spelling(7) + "xyz" * rng.randint(0, 1)
                                  for _ in range(rng.randint(0, 2))]
                           for kind in rng.sample(["noun", "verb", "adverb"], rng.randint(0, 2))})
            for _ in range(size)
        ]
        for name, size in {"one": 60, "two": 25, "tiny": 1}.items()
    }
    rows = [(name, pos, word, t) for name, words in sequences.items()
            for pos, (word, t) in enumerate(words)]
    rng.shuffle(rows)
    df = entry_frame(spark, rows).repartition(rng.randint(1, 8))
    got = {}
    for row in processed(df, distance=distance, neighbours=neighbours):
        got.setdefault(row.source_batch, []).append((row.pos, row.word, row.similar_words))
    for name, words in sequences.items():
        assert got.get(name, []) == by_hand(words, distance, neighbours)


def test_other_columns_stay(spark):
    df = entries(spark, ("ab", {"noun": ["x"]})).withColumn("note", F.lit("kept"))
    assert processed(df)[0].note == "kept"


def test_mid_sized_input(spark):
    words = [(f"wort{n}", {"noun": [f"wort{n}" if n % 11 == 0 else f"word {n}"]})
             for n in range(194)]
    rows = processed(entries(spark, *words))
    assert len(rows) == sum(n % 11 != 0 for n in range(194))
    assert [(r.pos, r.word, r.similar_words) for r in rows] == by_hand(words, 3, 50)


def test_cells_are_gathered_once(spark):
    plan = process_words(entries(spark, ("ab", {"noun": ["x"]})))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "CartesianProduct" not in plan


def test_sketches_lose_no_pair(spark):
    rng = random.Random(9)

    def edited(word, times):
        for _ in range(times):
            at = rng.randint(0, len(word))
            word = rng.choice([word[:at] + rng.choice("aé😀Z") + word[at:], word[:at] + word[at + 1 :], word[:at] + rng.choice("bß𝔸y") + word[at + 1 :]])
        return word

    pairs = []
    for n in range(400):
        word = "".join(rng.choice("abcÄß😀𝔸") for _ in range(rng.randint(0, 9)))
        pairs.append((word, edited(word, n % 5), n % 5))
    df = spark.createDataFrame(pairs, "l STRING, r STRING, n INT")
    for distance in range(5):
        alike = _alike(_sketched(F.col("l")), _sketched(F.col("r")), distance)
        assert df.filter(F.col("n") <= distance).filter(~alike).count() == 0


def test_negative_limits_are_refused(spark):
    df = entries(spark, ("a", {"noun": ["x"]}))
    with pytest.raises(ValueError):
        process_words(df, distance=-1)
    with pytest.raises(ValueError):
        process_words(df, neighbours=-1)


def test_category_labels(spark):
    df = spark.createDataFrame([("noun",), ("modal_verb",), ("Noun",), (None,)], "k STRING")
    known, strange = split_by_category(df, F.col("k"))
    assert (known.count(), strange.count()) == (2, 2)
    assert known.select(require_category(F.col("k"))).count() == 2
    with pytest.raises(Exception, match="Unknown grammar type: Noun"):
        df.filter("k = 'Noun'").select(require_category(F.col("k"))).collect()


def test_empty_categories(spark):
    df = entries(spark, ("a", None), ("b", {}))
    assert [r[0] for r in df.select(filled_categories(F.col("translations"))).collect()] == [[], []]


def test_similar_words_hold_one_frame_at_a_time(spark):
    """No cell is gathered whole, and what is compared is read behind the exchange (F2)."""
    entries = spark.range(3000).selectExpr(
        "concat('s', id div 3000) AS source_batch", "id AS pos", "concat('w', id % 7) AS word", "map('noun', array(concat('xyzuv', id % 5))) AS translations"
    )
    found = process_words(entries)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanged) == 1
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert "aggregate(" not in below
    sizes = {row.pos: len(row.similar_words) for row in found.collect()}
    assert sizes[0] == 50 and sizes[799] == sizes[800] == sizes[1500] == 100 and sizes[2999] == 50 and len(sizes) == 3000


def test_cells_of_few_bytes_are_dealt_to_many_tasks(spark):
    rows = [("s", at, f"word{at % 7}", {"noun": ["x"]}) for at in range(4000)]
    entries = spark.createDataFrame(rows, "source_batch STRING, pos BIGINT, word STRING, translations MAP<STRING, ARRAY<STRING>>")
    found = process_words(entries, 0, 2).withColumn("task", F.spark_partition_id()).filter("pos >= 0").collect()
    assert len({row.task for row in found}) > 3
    assert all(len(row.similar_words) == min(2, row.pos) + min(2, 3999 - row.pos) for row in found)
    assert all(row.similar_words == [] for row in process_words(entries, 3, 0).collect())


def test_neighbours_are_compared_as_arrays(spark):
    """No frame of entries is built for each row (F1)."""
    plan = process_words(entries(spark, ("ab", {"noun": ["x"]})))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan


@pytest.mark.parametrize("seed", range(4))
def test_blocks_of_entries_against_a_loop(monkeypatch, seed):
    """Texts of all lengths and signs, none, many or long further texts, little memory and small blocks (F1)."""
    rng = random.Random(seed)
    for name, value in {"BLOCK_ROWS": 40, "PLACES_AT_ONCE": 200, "PAIRS_AT_ONCE": 16, "TEXT_PAIRS_AT_ONCE": 3, "FOUND_AT_ONCE": 7, "MET": 30}.items():
        monkeypatch.setattr(alike, name, value)
    memory = alike.Memory
    monkeypatch.setattr(alike, "Memory", lambda: memory(20))
    distance, neighbours, letters = rng.randint(0, 4), rng.choice([1, 3, 9]), rng.choice(["ab", "abé", "aß😀𝔸"])

    def text():
        made = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 4, 7, 8, 9, 15])))
        return made + "x" * rng.choice([0, 0, 0, 7, 9, 30, 55, 58, 70])

    cells = [(name, cell, [(text() if rng.random() < 0.95 else None, [text() for _ in range(rng.choice([0, 1, 1, 1, 2, 5]))]) for _ in range(size)])
             for name, cell, size in (("s", 0, 90), ("s", 1, 30), ("t", 1, 1), (None, 1, 25))]
    rows = [(name, cell, at, rng.random() < 0.8, word, each, {"word": word, "at": at}) for name, cell, words in cells for at, (word, each) in enumerate(words)]
    table = pa.table({name: [row[i] for row in rows] for i, name in enumerate(("sequence", "cell", "at", "asks", "spelled", "meanings", "row"))})
    got = [row for batch in alike.similar_rows(table.to_batches(max_chunksize=17), distance, neighbours, "word") for row in batch.to_pylist()]
    wanted = []
    for name, cell, words in cells:
        asks = [row[3] for row in rows if row[:2] == (name, cell)]
        for at, (word, each) in enumerate(words):
            found = []
            for other in range(max(0, at - neighbours), min(len(words), at + neighbours + 1)):
                its, listed = words[other]
                pairs = [(a, b) for a in each for b in listed] + ([(word, its)] if None not in (word, its) else [])
                if other != at and any(edit_distance(a, b) <= distance for a, b in pairs):
                    found.append(its)
            if asks[at]:
                wanted.append({"row": {"word": word, "at": at}, "found": found})
    assert got == wanted


def test_words_of_texts_are_counted_by_documents(spark, tmp_path):
    """Texts of one id take turns, word by word, and no word is exchanged to be numbered (F1)."""
    rows = [(3, "en", "C c-c"), (1, "en", "one two  three"), (1, "en", "One two"), (2, "de", "ja"), (7, "en", None), (None, None, "x y"), (5, "en", "")]
    spark.createDataFrame(rows, "doc_id BIGINT, lang STRING, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    words = inputs.text_words(spark, str(tmp_path))
    got = sorted([tuple(row) for row in words.collect()], key=str)
    en = ["one", "one", "two", "two", "three", "c", "cc", ""]
    assert got == sorted([*(("en", pos, word) for pos, word in enumerate(en)), ("de", 0, "ja"), (None, 0, "x"), (None, 1, "y")], key=str)
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate posexplode")]
