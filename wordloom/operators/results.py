"""Result lines to word entries, error rows and set-aside rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.json import is_truthy, keys_in_order, kind_of, strict_json, text_lists
from wordloom.functions.text import strip_white
from wordloom.operators.ordering import dense_positions
from wordloom.session import REPEATED_MEMBERS


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``value``: the line as VARIANT, NULL where it is not one JSON value.

    Of a repeated member the last one counts, also where the session was built elsewhere.
    """
    lines.sparkSession.conf.set(REPEATED_MEMBERS, "true")
    return lines.withColumn("value", strict_json(F.col(line)))


def _field(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def route_results(parsed: DataFrame, stage: str = "result") -> DataFrame:
    """Give every parsed result a ``route``: word, error, refusal or quarantine.

    Input columns ``source, block, line_id, value`` and, for lines, ``line``. A line holding
    ``null`` is dropped. The error is looked at before the refusal, and only the first choice.
    A result without choices, text or list of entries goes to quarantine with the reason.

    Output: ``source, block, line_id, route, custom_id, error`` (JSON text), ``content`` and
    ``response`` (the answer as text and its list of entries as VARIANT, of words only), ``stage, reason, raw``.
    :func:`entry_rows` reads the entries.
    """
    value = F.col("value")
    line = F.col("line") if "line" in parsed.columns else F.to_json(value)
    first = "$.response.body.choices[0].message"
    content = _field(value, f"{first}.content")
    fields = parsed.select(
        "source",
        "block",
        "line_id",
        line.alias("raw"),
        value,
        _field(value, "$.custom_id", "string").alias("custom_id"),
        _field(value, "$.error").alias("error"),
        _field(value, first).alias("message"),
        _field(value, f"{first}.refusal").alias("refusal"),
        F.when(kind_of(content) == "STRING", content.cast("string")).alias("content"),
    ).filter(F.col("value").isNull() | ~F.is_variant_null("value"))

    kind = (
        F.when(F.col("value").isNull(), "quarantine")
        .when(is_truthy(F.col("error")), "error")
        .when(is_truthy(F.col("refusal")), "refusal")
        .otherwise("word")
    )
    answered = F.col("kind") == "word"
    payload = F.when(answered, strict_json(F.col("content")))
    response = _field(F.col("payload"), "$.response")
    reason = F.when(F.col("value").isNull(), "malformed line").when(
        answered,
        F.when(F.col("message").isNull(), "no message")
        .when(F.col("content").isNull(), "no content")
        .when(F.col("payload").isNull(), "malformed content")
        .when(~F.coalesce(kind_of(F.col("response")).startswith("ARRAY"), F.lit(False)), "no list of entries"),
    )
    judged = (
        fields.withColumn("kind", kind)
        .withColumn("payload", payload)
        .withColumn("response", response)
        .withColumn("reason", reason)
    )
    set_aside = F.col("reason").isNotNull()
    bad_content = F.col("reason").isin("malformed content", "no list of entries")
    told = F.when(F.col("kind") == "error", F.col("error")).when(
        F.col("kind") == "refusal", F.col("refusal")
    )
    return judged.select(
        "source",
        "block",
        "line_id",
        F.when(set_aside, "quarantine").otherwise(F.col("kind")).alias("route"),
        "custom_id",
        F.to_json(told).alias("error"),
        F.when(answered & ~set_aside, F.col("content")).alias("content"),
        F.when(answered & ~set_aside, F.col("response")).alias("response"),
        F.when(bad_content, "content").otherwise(F.lit(stage)).alias("stage"),
        "reason",
        F.when(set_aside, F.when(bad_content, F.col("content")).otherwise(F.col("raw")))
        .alias("raw"),
    )


def route_errors(parsed: DataFrame) -> DataFrame:
    """Error file lines in the shape of :func:`route_results`; ``null`` lines are dropped."""
    value = F.col("value")
    kept = parsed.filter(value.isNull() | ~F.is_variant_null(value))
    line = F.col("line") if "line" in parsed.columns else F.to_json(value)
    bad = value.isNull()
    return kept.select(
        "source",
        "block",
        "line_id",
        F.when(bad, "quarantine").otherwise("error").alias("route"),
        _field(value, "$.custom_id", "string").alias("custom_id"),
        F.to_json(value).alias("error"),
        F.lit(None).cast("string").alias("content"),
        F.try_parse_json(F.lit(None).cast("string")).alias("response"),
        F.lit("error file").alias("stage"),
        F.when(bad, "malformed line").alias("reason"),
        F.when(bad, line).alias("raw"),
    )


def entry_rows(routed: DataFrame) -> DataFrame:
    """The entries of word lines, a row each: ``source, block, line_id, item, word, translations, reason, raw``.

    The VARIANT gives the values, the text the order of the keys. A translation list may be missing, or be one
    string. An entry that is no object with a text as its word and lists of texts as its translations has a reason
    and its JSON text instead. Every step is a column of its own, so nothing is read twice for an entry.
    """
    texts = F.from_json("content", "response ARRAY<STRING>")["response"]
    listed = F.arrays_zip(texts.alias("text"), _field(F.col("response"), "$", "array<variant>").alias("value"))
    place = ["source", "block", "line_id", "item"]
    exploded = routed.filter(F.col("route") == "word").select("source", "block", "line_id", F.posexplode(listed).alias("item", "entry"))
    value = F.col("entry.value")
    read = exploded.select(
        *place,
        F.col("entry.text").alias("text"),
        kind_of(value).alias("kind"),
        _field(value, "$.word").alias("word"),
        kind_of(_field(value, "$.word")).alias("word_kind"),
        kind_of(_field(value, "$.translations")).alias("listed_kind"),
        _field(value, "$.translations", "map<string,variant>").alias("values"),
        F.json_object_keys(F.get_json_object("entry.text", "$.translations")).alias("told"),
    )
    keyed = read.select("*", keys_in_order(F.col("values"), F.col("told")).alias("keys"))
    lists = keyed.select("*", text_lists(F.col("values"), F.col("keys")).alias("lists"))
    absent = F.coalesce(F.col("listed_kind") == "VOID", F.lit(True))
    whole = F.coalesce(F.forall(F.map_values("lists"), lambda x: x.isNotNull()), F.lit(False))
    missing = F.coalesce(F.col("word_kind") == "VOID", F.lit(True)) & F.coalesce(F.col("kind").startswith("OBJECT"), F.lit(False))
    readable = F.coalesce(F.col("word_kind") == "STRING", F.lit(False)) & (absent | whole)
    judged = lists.select("*", absent.alias("absent"), F.when(readable, None).when(missing, "no word").otherwise("mistyped entry").alias("reason"))
    good = F.col("reason").isNull()
    return judged.select(
        *place,
        F.when(good, F.col("word").cast("string")).alias("word"),
        F.when(good & ~F.col("absent"), F.col("lists")).alias("translations"),
        "reason",
        F.when(~good, F.coalesce("text", F.lit("null"))).alias("raw"),
    )


def word_entries(routed: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Word entries in result order, then list order, with a dense ``pos`` per source.

    Columns: ``source_batch, pos, word, translations``. ``routed`` must be staged, or ``entries`` (:func:`entry_rows`)
    given as staged: they are read twice, and file blocks bound the rows that are numbered together.
    """
    read = (entry_rows(routed) if entries is None else entries).filter(F.col("reason").isNull())
    numbered = dense_positions(read, ["line_id", "item"], ["source"], name="pos", chunk=F.col("block"))
    return numbered.select(F.col("source").alias("source_batch"), "pos", "word", "translations")


def error_rows(routed: DataFrame) -> DataFrame:
    """``source_batch, custom_id, type, error`` of errors and refusals."""
    return routed.filter(F.col("route").isin("error", "refusal")).select(
        F.col("source").alias("source_batch"), "custom_id", F.col("route").alias("type"), "error"
    )


def quarantine_rows(routed: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """``source_batch, stage, reason, line`` of what could not be used, white space stripped."""
    lines = routed.filter(F.col("route") == "quarantine").select("source", "stage", "reason", "raw")
    unread = (entry_rows(routed) if entries is None else entries).filter(F.col("reason").isNotNull())
    both = lines.unionByName(unread.select("source", F.lit("entry").alias("stage"), "reason", "raw"))
    return both.select(F.col("source").alias("source_batch"), "stage", "reason", strip_white(F.col("raw")).alias("line"))
