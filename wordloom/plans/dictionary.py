"""Processed words to the dictionary tables, in a way that can be run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.words import known_category, typed_translations
from wordloom.operators.checks import duplicate_keys, null_counts, orphans, outside_domain
from wordloom.operators.lookups import key_counts, largest_id, lookup_join, new_rows
from wordloom.operators.ordering import running_totals
from wordloom.schemas import ENGLISH, FOREIGN_KEYS, GERMAN, GRAMMAR_TYPES, LANGUAGES, PARTITIONS, TABLES
from wordloom.session import stage, temporary_stages
from wordloom.sources.sinks import (
    append_rows,
    last_ids,
    read_table,
    replace_batches,
    reserve_ids,
)

CHILD_TABLES = ("translation", "similar_word", "grammar_category")
# Places of a source batch whose children are numbered together.
PLACES_PER_PIECE = 1 << 16


class UnknownCategory(ValueError):
    """A word entry has a category that is not a grammar label."""


class UnknownLanguage(ValueError):
    """A language number is not in the language table."""


def seed_languages(names: DataFrame, existing: DataFrame) -> DataFrame:
    """The languages of ``names`` (``id, name``) not in ``existing``, with new ids in list order."""
    listed = names.groupBy("name").agg(F.min("id").alias("_place"))
    added = new_rows(listed, existing, ["name"], largest_id(existing), order=["_place"])
    return added.select(F.col("id").cast("int").alias("id"), "name")


def save_languages(names: DataFrame, root: str) -> None:
    """Add the languages of ``names`` (``id, name``) that are not stored; running again adds none."""
    with temporary_stages(names.sparkSession):
        existing = read_table(names.sparkSession, root, "language")
        append_rows(stage(seed_languages(names, existing), "languages"), root, "language")


def require_languages(spark: SparkSession, root: str, *ids: int) -> None:
    """Fail for a number that is not in the language table. One that was never stored holds ``LANGUAGES``."""
    stored = [row.id for row in read_table(spark, root, "language").filter(F.col("id").isin(*ids)).collect()]
    if not stored and read_table(spark, root, "language").isEmpty():
        stored = range(1, len(LANGUAGES) + 1)
    missing = sorted(set(ids) - set(stored))
    if missing:
        raise UnknownLanguage(f"No language has the number {missing[0]}")


def unknown_categories(processed: DataFrame) -> DataFrame:
    """``word, category`` of entries with a category that is not a grammar label."""
    labels = F.explode(F.map_keys("translations")).alias("category")
    return processed.select("word", labels).filter(~known_category(F.col("category")))


def new_words(
    counts: DataFrame, words: DataFrame, primary_language: int, last_id: int
) -> DataFrame:
    """The words of ``counts`` missing in ``words``, with ids in word order.

    ``counts`` has one row per word of the input, ``words`` the stored words of the language.
    """
    found = new_rows(counts.select("word"), words, ["word"], last_id)
    return found.withColumn("primary_language", F.lit(primary_language))


def with_word_ids(processed: DataFrame, ids: DataFrame, counts: DataFrame) -> DataFrame:
    """Add ``word_id``; rows of a word without id go. ``ids`` has each word once."""
    listed = ids.select("word", F.col("id").alias("word_id"))
    return lookup_join(processed, listed, ["word"], "inner", counts)


def _child_sizes(rows: DataFrame) -> dict[str, Column]:
    """Child rows of a processed word, per table."""
    steps = "similar_steps" if "similar_steps" in rows.columns else "similar_words"
    return {
        "translation": F.size(typed_translations(F.col("translations"))),
        "similar_word": F.col("n_similar") if "n_similar" in rows.columns else F.size(steps),
        "grammar_category": F.size("grammar_categories"),
    }


def number_children(rows: DataFrame, last_ids: dict[str, int]) -> DataFrame:
    """Add the id before each row's first child, per child table, in source and place order."""
    sizes = _child_sizes(rows)
    numbered = running_totals(
        rows,
        ["source_batch", "pos"],
        {f"_{name}_id": size for name, size in sizes.items()},
        chunk=F.struct("source_batch", F.expr(f"pos div {PLACES_PER_PIECE}").alias("piece")),
    )
    for name in sizes:
        column = f"_{name}_id"
        numbered = numbered.withColumn(column, F.col(column) + F.lit(last_ids.get(name, 0)))
    return numbered


def _apart(processed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged: the processed words with ``n_similar`` for their similar words, and those, a row each.

    A list of similar words holds up to a hundred whole words, however long each is, and a reader takes thousands of
    rows at once; so no list is stored, shuffled with its word or sorted. A word and its list are one pass.
    """
    others = [name for name in processed.columns if name != "similar_words"]
    first = F.array(F.lit(None).cast("string"))
    listed = processed.select(
        *others, F.size("similar_words").alias("n_similar"), F.posexplode(F.concat(first, "similar_words")).alias("place", "similar_word")
    )
    # Place 0 stands for the word itself, which is told there only.
    places = {"source_batch", "pos"}
    told = [F.col(name) if name in places else F.when(F.col("place") == 0, F.col(name)).alias(name) for name in (*others, "n_similar")]
    kept = stage(listed.select(*told, "place", "similar_word"), "processed")
    words = kept.filter(F.col("place") == 0).select(*others, "n_similar")
    return words, kept.filter(F.col("place") > 0).select("source_batch", "pos", (F.col("place") - 1).alias("at"), F.col("similar_word").alias("item"))


def child_rows(
    numbered: DataFrame, primary_language: int = GERMAN, secondary_language: int = ENGLISH, similar: DataFrame | None = None
) -> dict[str, DataFrame]:
    """The rows of the three child tables, from :func:`number_children`. Narrow, but for ``similar``.

    ``similar`` holds the similar words (``source_batch, pos, at, item``) where ``numbered`` has no lists of them. With
    ``similar_steps`` in ``numbered`` the rows of similar words have the ``pos`` of theirs instead.
    """
    languages = {
        "primary_language": F.lit(primary_language),
        "secondary_language": F.lit(secondary_language),
    }

    def flatten(table: str, items: Column | DataFrame, fields: dict[str, str]) -> DataFrame:
        if isinstance(items, DataFrame):
            exploded = items.join(numbered.select("source_batch", "pos", "word_id", f"_{table}_id"), ["source_batch", "pos"])
        else:
            exploded = numbered.select(
                "word_id", "source_batch", f"_{table}_id", F.posexplode(items).alias("at", "item")
            )
        return exploded.select(
            (F.col(f"_{table}_id") + F.col("at") + 1).alias("id"),
            "word_id",
            *[F.col(path).alias(name) for name, path in fields.items()],
            *[languages[name].alias(name) for name in PARTITIONS[table] if name in languages],
            "source_batch",
        )

    if "similar_steps" in numbered.columns:
        places = F.transform("similar_steps", lambda step: F.col("pos") + step)
        # What belongs to no source batch has similar words of no batch: none are stored, as where they are joined.
        similar_rows = flatten("similar_word", places, {"pos": "item"}).filter(F.col("source_batch").isNotNull())
    else:
        similar_rows = flatten("similar_word", F.col("similar_words") if similar is None else similar, {"similar_word": "item"})
    return {
        "translation": flatten(
            "translation",
            typed_translations(F.col("translations")),
            {"type": "item.type", "translation": "item.translation"},
        ),
        "similar_word": similar_rows,
        "grammar_category": flatten(
            "grammar_category", F.col("grammar_categories"), {"category": "item"}
        ),
    }


def save_dictionary(
    processed: DataFrame,
    root: str,
    primary_language: int = GERMAN,
    secondary_language: int = ENGLISH,
    batches: DataFrame | None = None,
    entries: DataFrame | None = None,
) -> None:
    """Store processed words: new words, then translations, similar words and categories.

    A word is stored once per language and keeps its id. The child rows of a source batch
    replace those of an earlier run, so running again changes nothing. ``batches`` lists the
    source batches of the run where some may have no words left. An unknown category fails
    before anything is written. One writer per table at a time.

    Where ``processed`` has ``similar_steps``, ``entries`` (staged; ``source_batch, pos, word`` of all entries, also of those
    that are not processed) tells the words: they are sent once, whatever the number of words they are similar to.
    """
    spark = processed.sparkSession
    with temporary_stages(spark):
        require_languages(spark, root, primary_language, secondary_language)
        processed, similar = (stage(processed, "processed"), None) if "similar_steps" in processed.columns else _apart(processed)
        batches = processed if batches is None else batches
        strange = unknown_categories(processed).take(1)
        if strange:
            raise UnknownCategory(f"Unknown grammar type: {strange[0].category}")

        counts = stage(key_counts(processed, ["word"]), "word-counts")
        last = last_ids(spark, root, ("word", *CHILD_TABLES))
        stored = read_table(spark, root, "word")
        known = stored.filter(F.col("primary_language") == primary_language).select("id", "word")
        known = stage(known.join(counts.select("word"), "word", "left_semi"), "known-words")
        added = stage(new_words(counts, known, primary_language, last["word"]), "new-words")
        totals = {row.table_name: row.n_rows for row in child_totals(processed).collect()}
        totals["word"] = added.count()
        reserve_ids(spark, root, {name: last[name] + totals[name] for name in last})
        append_rows(added, root, "word")

        ids = known.unionByName(added.select("id", "word"))
        # The words themselves, of any length, have done their part.
        numbered = stage(number_children(with_word_ids(processed, ids, counts).drop("word"), last), "with-word-ids")
        similar_texts = entries.select("source_batch", "pos", F.col("word").alias("similar_word")) if similar is None else None
        fixed = {"primary_language": primary_language, "secondary_language": secondary_language}
        for table, rows in child_rows(numbered, primary_language, secondary_language, similar).items():
            wanted = {name: fixed[name] for name in PARTITIONS[table] if name in fixed}
            replace_batches(rows, root, table, batches, similar_texts if table == "similar_word" else None, **wanted)


def child_totals(processed: DataFrame) -> DataFrame:
    """``table_name, n_rows`` of the child rows of ``processed``."""
    sizes = _child_sizes(processed)
    totals = processed.agg(
        *[F.coalesce(F.sum(size), F.lit(0)).alias(name) for name, size in sizes.items()]
    )
    return totals.unpivot([], list(sizes), "table_name", "n_rows")


def expected_counts(processed: DataFrame) -> DataFrame:
    """``table_name, n_rows`` that saving ``processed`` must give."""
    words = processed.agg(F.countDistinct("word").alias("n_rows"))
    return child_totals(processed).unionByName(
        words.select(F.lit("word").alias("table_name"), "n_rows")
    )


def save_audit(
    spark: SparkSession, processed: DataFrame, root: str, primary_language: int = GERMAN
) -> DataFrame:
    """``table_name, expected, stored`` for the words and batches of ``processed``, after saving it.

    Counts only what belongs to this run, whatever else the dictionary holds.
    """
    words = read_table(spark, root, "word").filter(F.col("primary_language") == primary_language)
    words = words.join(processed.select("word").distinct(), "word", "left_semi")
    found = {"word": words}
    for table in CHILD_TABLES:
        rows = read_table(spark, root, table).filter(F.col("primary_language") == primary_language)
        found[table] = rows.join(processed.select("source_batch").distinct(), "source_batch", "left_semi")
    stored = None
    for table, rows in found.items():
        count = rows.agg(F.count(F.lit(1)).alias("stored")).withColumn("table_name", F.lit(table))
        stored = count if stored is None else stored.unionByName(count)
    expected = expected_counts(processed).withColumnRenamed("n_rows", "expected")
    return expected.join(stored, "table_name").select("table_name", "expected", "stored")


def dictionary_check(spark: SparkSession, root: str) -> DataFrame:
    """``table_name, problem, column, value, n_rows`` of what breaks a rule of the stored tables.

    The foreign keys, unique names and words, filled columns, and the grammar labels. No rows: all hold.
    """
    tables = {name: read_table(spark, root, name) for name in ("language", "word", *CHILD_TABLES)}

    def problem(table: str, kind: str, column: str, rows: DataFrame, value: str | None) -> DataFrame:
        told = F.col(value).cast("string") if value else F.lit(None).cast("string")
        return rows.select(
            F.lit(table).alias("table_name"), F.lit(kind).alias("problem"), F.lit(column).alias("column"),
            told.alias("value"), F.col("n_rows").cast("bigint").alias("n_rows"),
        )

    found = []
    for child, key, parent, parent_key in FOREIGN_KEYS:
        rows = orphans(tables[child], key, tables[parent], parent_key)
        found.append(problem(child, "orphan", key, rows, key))
    for table, keys in (("language", ["id"]), ("language", ["name"]), ("word", ["id"]), ("word", ["word", "primary_language"])):
        found.append(problem(table, "duplicate", ",".join(keys), duplicate_keys(tables[table], keys), keys[0]))
    for table, rows in tables.items():
        nulls = null_counts(rows, [name.split(" ")[0] for name in TABLES[table].split(", ")])
        found += [problem(table, "null", "", nulls, "column")]
    for table, column in (("translation", "type"), ("grammar_category", "category")):
        found.append(problem(table, "label", column, outside_domain(tables[table], column, GRAMMAR_TYPES), column))
    checks = found[0]
    for rows in found[1:]:
        checks = checks.unionByName(rows)
    return checks


def word_differences(processed: DataFrame, words: DataFrame) -> DataFrame:
    """``word, problem``: duplicate in the input, missing in the table, or extra in the table."""
    counts = key_counts(processed, ["word"])
    stored = words.select("word").distinct()

    def labelled(df: DataFrame, problem: str) -> DataFrame:
        return df.select("word", F.lit(problem).alias("problem"))

    return (
        labelled(counts.filter(F.col("n_rows") > 1), "duplicate")
        .unionByName(labelled(counts.join(stored, "word", "left_anti"), "missing"))
        .unionByName(labelled(stored.join(counts, "word", "left_anti"), "extra"))
    )
