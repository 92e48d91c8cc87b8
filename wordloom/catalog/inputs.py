"""Subtitles, word lists, result lines and word entries made from the given tables.

The tables hold no subtitles or model answers. Each input below is a fixed rule over a whole
table, with the awkward cases the operators must get right; the SQL side applies the same rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.text import keep_word_characters, split_words
from wordloom.operators.ordering import dense_positions, running_totals
from wordloom.plans.dictionary import new_words
from wordloom.schemas import PAYLOAD, TRANSLATIONS
from wordloom.session import stage

# Rows of one piece when rows are numbered by an integer key.
KEYS_PER_PIECE = 1 << 20
# Rows of one written file or document.
KEYS_PER_FILE = 1 << 15

HEAD = "1\n00:00:00,000 --> 00:00:02,000\n"
CUE = "\n\n2\n00:00:02,000 --> 00:00:04,000\n<i>"
TAIL = "</i>\n\n3\n00:00:04,000 --> 00:00:06,000\n1984\nlost line\n["


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows take much work each, dealt out evenly: files may hold few row groups."""
    texts = table(spark, sf_dir, name)
    return texts.repartition(max(spark.sparkContext.defaultParallelism, texts.rdd.getNumPartitions()))


def as_subtitle(text: Column, note: Column) -> Column:
    """A subtitle with one cue per line of the text, a number line in dialogue and a note."""
    cues = F.replace(text, F.lit("\n"), F.lit(CUE))
    return F.concat(F.lit(HEAD), cues, F.lit(TAIL), note, F.lit("]\n"))


def document_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_table(spark, sf_dir, "documents").select(
        "doc_id", as_subtitle(F.col("text"), F.col("lang")).alias("text")
    )


def conversation_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One subtitle per turn."""
    return text_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", as_subtitle(F.col("text"), F.col("role")).alias("text")
    )


def words_of(text: Column) -> Column:
    return split_words(keep_word_characters(text))


def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct lower-case words of the benchmark: the words already known."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(words_of(F.col("text"))).alias("w"))
    return words.filter("w <> ''").select(F.lower("w").alias("word")).distinct()


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents: ``doc_id, lang, pos, token``."""
    return text_table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.posexplode(words_of(F.col("text"))).alias("pos", "token")
    )


def text_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents, in lower case and without other signs: ``lang, pos, word``.

    ``pos`` counts the words of a language, by ``doc_id`` and the place in the text; texts of one id take turns. Documents
    are counted on, not words, so that words are never ordered, and texts are shuffled once.
    """
    documents = table(spark, sf_dir, "documents")
    letters = F.regexp_replace(F.lower("text"), r"[^\p{L}\s]", "")
    n_words = F.size(F.coalesce(F.split(letters, r"\s+"), F.array().cast("array<string>")))
    counted = text_table(spark, sf_dir, "documents").groupBy("lang", "doc_id").agg(F.sum(n_words).alias("n_words"))
    starts = running_totals(
        stage(counted, "text-words"), ["doc_id"], {"start": F.col("n_words")}, ["lang"], chunk=F.expr(f"doc_id div {KEYS_PER_PIECE}")
    )
    none = F.lit(None)
    texts = documents.select("lang", "doc_id", "text", none.cast("bigint").alias("start"))
    placed = texts.unionByName(starts.select("lang", "doc_id", none.cast("string").alias("text"), "start"))
    gathered = placed.groupBy("lang", "doc_id").agg(F.collect_list(letters).alias("texts"), F.max("start").alias("start"))
    lists = gathered.select("lang", "start", F.transform("texts", lambda text: F.split(text, r"\s+")).alias("lists"))
    longest = F.coalesce(F.array_max(F.transform("lists", F.size)), F.lit(0))
    turns = F.transform(
        F.sequence(F.lit(0), longest - 1), lambda at: F.array_compact(F.transform("lists", lambda words: F.get(words, at)))
    )
    words = F.when(F.size("lists") == 1, F.element_at("lists", 1)).when(longest > 0, F.flatten(turns))
    told = lists.select("lang", "start", F.posexplode(words).alias("at", "word"))
    return told.select("lang", (F.col("start") + F.col("at")).alias("pos"), "word")


def language_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct lower-case words per language."""
    tokens = document_tokens(spark, sf_dir).filter("token <> ''")
    return tokens.select("lang", F.lower("token").alias("word")).distinct()


def part_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word entry per part, in one sequence per brand.

    Some words equal their only translation, some entries have no translation, some lists are
    missing.
    """
    kind = F.lower("p_type")
    none = F.array().cast("array<string>")
    entries = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_brand").alias("source_batch"),
        F.when(F.col("p_size") % 4 == 0, kind).otherwise(F.col("p_name")).alias("word"),
        F.create_map(
            F.lit("noun"),
            F.when(F.col("p_size") % 5 == 0, none).otherwise(F.array(kind)),
            F.lit("verb"),
            F.when(F.col("p_size") % 3 == 0, F.lit(None).cast("array<string>")).otherwise(none),
            F.lit("adjective"),
            F.when(F.col("p_size") % 7 == 0, F.array("p_brand", "p_name")).otherwise(none),
        ).cast(TRANSLATIONS).alias("translations"),
    )
    return dense_positions(
        entries, ["p_partkey"], ["source_batch"],
        chunk=F.expr(f"p_partkey div {KEYS_PER_PIECE}"),
    )


def part_known_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part types as the words already stored: ``id, word``, ids from 1 in word order."""
    kinds = table(spark, sf_dir, "part").select(F.lower("p_type").alias("word")).distinct()
    nothing = spark.createDataFrame([], "id BIGINT, word STRING")
    return new_words(kinds, nothing, 12, 0).select("id", "word")


def envelope(
    custom_id: Column, content: Column, error: Column | None = None, refusal: Column | None = None
) -> Column:
    """A result line around the text of the answer."""
    null = F.lit(None).cast("string")
    message = F.struct(
        F.lit("assistant").alias("role"),
        content.alias("content"),
        (null if refusal is None else refusal).alias("refusal"),
    )
    choice = F.struct(F.lit(0).alias("index"), message.alias("message"))
    body = F.struct(F.lit("chat.completion").alias("object"), F.array(choice).alias("choices"))
    response = F.struct(F.lit(200).alias("status_code"), body.alias("body"))
    return F.to_json(
        F.struct(
            custom_id.alias("custom_id"),
            response.alias("response"),
            (null if error is None else error).alias("error"),
        ),
        {"ignoreNullFields": "false"},
    )


def answer(entries: Column) -> Column:
    """The text of an answer with these entries."""
    kind = PAYLOAD.split(" ", 1)[1]
    return F.to_json(F.struct(entries.cast(kind).alias("response")))


def part_result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result line per part with an entry per word of its name: ``source, block, line_id, line``."""
    kind = F.lower("p_type")
    entries = F.transform(
        F.split("p_name", " "),
        lambda word: F.struct(
            word.alias("word"),
            F.create_map(
                F.lit("noun"), F.array(F.col("p_type"), kind),
                F.lit("verb"), F.array().cast("array<string>"),
                F.lit("adjective"), F.array(F.col("p_name")),
            ).alias("translations"),
        ),
    )
    key = F.col("p_partkey")
    return text_table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("source"),
        F.expr(f"p_partkey div {KEYS_PER_PIECE}").alias("block"),
        key.alias("line_id"),
        envelope(F.concat(F.lit("request-"), key.cast("string")), answer(entries)).alias("line"),
    )


def document_result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result line per document with its whole text in it; the last digit of the id picks a case."""
    text, case = F.col("text"), F.col("doc_id") % 10
    custom_id = F.concat(F.lit("request-"), F.col("doc_id").cast("string"))
    entry = F.array(
        F.struct(
            text.alias("word"),
            F.create_map(F.lit("noun"), F.array("lang")).alias("translations"),
        )
    )
    fine = answer(entry)
    null = F.lit(None).cast("string")
    error = F.when(case.isin(0, 7), text).when(case == 8, F.lit(""))
    refusal = F.when(case.isin(1, 7), text)
    content = (
        F.when(case == 4, F.concat(F.lit("{"), text))
        .when(case == 5, null)
        .when(case == 9, F.lit('{"answer":[]}'))
        .otherwise(fine)
    )
    line = envelope(custom_id, content, error, refusal)
    return text_table(spark, sf_dir, "documents").select(
        F.col("source"),
        F.expr("doc_id div 65536").alias("block"),
        F.col("doc_id").alias("line_id"),
        F.when(case == 2, F.concat(F.lit("{"), text))
        .when(case == 3, F.lit("null"))
        .when(case == 6, F.concat(line, F.lit(" x")))
        .otherwise(line)
        .alias("line"),
    )
