"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.catalog import inputs
from wordloom.catalog.inputs import KEYS_PER_FILE, KEYS_PER_PIECE, table, text_table
from wordloom.functions.words import filled_categories, require_category
from wordloom.operators.checks import (
    duplicate_keys,
    null_counts,
    orphans,
    outside_domain,
    split_by_category,
)
from wordloom.operators.enrich import drop_untranslated, process_words
from wordloom.operators.lookups import drop_listed, key_counts, largest_id, new_rows
from wordloom.operators.ordering import dense_positions
from wordloom.operators.packing import chunk_rows, pack_words, valid_word_lists
from wordloom.operators.paging import find_one, page, page_after
from wordloom.operators.requests import batch_sizes, build_requests, oversized_batches
from wordloom.operators.results import (
    entry_rows,
    error_rows,
    parse_lines,
    quarantine_rows,
    route_errors,
    route_results,
    word_entries,
)
from wordloom.operators.status import latest_status
from wordloom.operators.subtitles import (
    corpus_words,
    distinct_words,
    remove_words,
    subtitle_tokens,
)
from wordloom.plans import decks
from wordloom.plans.dictionary import (
    child_rows,
    dictionary_check,
    new_words,
    number_children,
    save_audit,
    save_dictionary,
    save_languages,
    seed_languages,
    with_word_ids,
    word_differences,
)
from wordloom.plans.ingest import ingest_documents, ingest_results
from wordloom.schemas import LANGUAGES
from wordloom.session import LONG_ROWS, stage, staged_path
from wordloom.sources.files import (
    document_rows,
    read_json_lines,
    read_languages,
    read_result_documents,
    read_subtitles,
    read_word_list,
)
from wordloom.sources.sinks import append_rows, read_table, write_requests
from wordloom.streaming.ingest import start_ingest
from wordloom.streaming.status import read_states, start_status

WORDS_PER_REQUEST = 8
# Limits that some of the batches break.
MAX_LINES, MAX_BYTES = 500, 180_000
REQUESTS_PER_BATCH = 500


def deck_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = inputs.document_subtitles(spark, sf_dir)
    return decks.deck_words(texts, inputs.benchmark_words(spark, sf_dir))


def subtitle_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitle_tokens(inputs.conversation_subtitles(spark, sf_dir))


def conversation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = subtitle_tokens(inputs.conversation_subtitles(spark, sf_dir))
    return distinct_words(tokens, ["turn", "pos"], ["conv_id"])


def corpus_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = text_table(spark, sf_dir, "documents")
    return corpus_words(documents, ["doc_id"], subtitles=False)


def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = inputs.document_tokens(spark, sf_dir).select("doc_id", "pos", "token")
    return remove_words(tokens, inputs.benchmark_words(spark, sf_dir), "token")


def stopword_filter_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a list taken as too large to broadcast."""
    tokens = inputs.document_tokens(spark, sf_dir).select("doc_id", "pos", "token")
    known = inputs.benchmark_words(spark, sf_dir)
    return drop_listed(tokens, F.lower("token"), known, broadcast_bytes=0)


def subtitle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = staged_path(spark, "subtitle-files")
    texts = table(spark, sf_dir, "benchmark").select(
        inputs.as_subtitle(F.col("text"), F.lit("note"))
    )
    texts.write.option("maxRecordsPerFile", 1).text(folder)
    tokens = subtitle_tokens(read_subtitles(spark, folder))
    return tokens.groupBy("pos", "token").agg(F.count(F.lit(1)).alias("n_files"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_words(
        inputs.language_words(spark, sf_dir),
        order=["word"],
        by=["lang"],
        words_per_request=WORDS_PER_REQUEST,
        requests_per_batch=REQUESTS_PER_BATCH,
    )


def request_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).withColumn("words", F.array_join("words", "|"))


def chunk_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_rows(
        table(spark, sf_dir, "orders"),
        "o_orderkey",
        4,
        order=["o_orderkey"],
        by=["o_custkey"],
        chunk=F.expr(f"o_orderkey div {KEYS_PER_PIECE}"),
    )
    return chunks.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


def _request_lines(spark: SparkSession, sf_dir: str, modes: tuple[str, ...] = ("plain", "structured")) -> DataFrame:
    packed = stage(_packed(spark, sf_dir), "packed")
    columns = ["mode", "lang", "batch_id", "request_id", "custom_id", "user_message", "line"]
    lines = None
    for mode in modes:
        schema = {"type": "object"} if mode == "structured" else None
        built = build_requests(packed, mode, system_message="sys", answer_schema=schema)
        built = built.withColumn("mode", F.lit(mode)).select(columns)
        lines = built if lines is None else lines.unionByName(built)
    return lines


def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _request_lines(spark, sf_dir)


def request_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _request_lines(spark, sf_dir)
    keys = ["mode", "lang", "batch_id"]
    beyond = oversized_batches(lines, keys, max_lines=MAX_LINES, max_bytes=MAX_BYTES).select(
        *keys, F.lit(True).alias("too_large")
    )
    sizes = batch_sizes(lines, keys).join(beyond, keys, "left")
    return sizes.withColumn("too_large", F.coalesce("too_large", F.lit(False)))


def request_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = staged_path(spark, "request-files")
    lines = _request_lines(spark, sf_dir, ("structured",))
    write_requests(lines, folder, by=["lang", "batch_id"])
    read = spark.read.schema("value STRING, lang STRING, batch_id BIGINT").text(folder)
    return read.select("lang", "batch_id", F.col("value").alias("line"))


def wordlist_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = F.transform(F.split("text", "\n"), lambda line: F.split(line, "[.,]"))
    return text_table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(lists).cast("bigint").alias("n_lists"),
        valid_word_lists(lists).alias("valid"),
    )


def word_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = staged_path(spark, "word-lists")
    names = table(spark, sf_dir, "part").select(
        "p_brand",
        F.expr(f"p_partkey div {KEYS_PER_FILE}").alias("file_no"),
        "p_partkey",
        # CRLF files with blank lines among the words.
        F.when(F.col("p_size") % 9 == 0, F.concat("p_name", F.lit("\r\n \r")))
        .otherwise(F.concat("p_name", F.lit("\r")))
        .alias("line"),
    )
    (
        names.repartition("p_brand", "file_no")
        .sortWithinPartitions("p_brand", "file_no", "p_partkey")
        .select("p_brand", "file_no", "line")
        .write.partitionBy("p_brand", "file_no")
        .text(folder)
    )
    requests = decks.word_list_requests(
        read_word_list(spark, folder), words_per_request=5, requests_per_batch=3
    )
    return requests.groupBy("batch_id", "request_id", "user_message").agg(
        F.count(F.lit(1)).alias("n_requests")
    )


def _routed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = inputs.document_result_lines(spark, sf_dir)
    return stage(route_results(parse_lines(lines)), "routed")


def result_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = _routed_documents(spark, sf_dir)
    told = F.try_variant_get(F.parse_json("error"), "$", "string")
    return routed.select(
        F.col("line_id").alias("doc_id"),
        "route",
        "custom_id",
        "reason",
        F.md5(F.coalesce(F.try_variant_get("response", "$[0].word", "string"), told)).alias("told"),
    )


def result_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = error_rows(_routed_documents(spark, sf_dir))
    told = F.md5(F.try_variant_get(F.parse_json("error"), "$", "string"))
    return rows.select("source_batch", "custom_id", "type", told.alias("told"))


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine_rows(_routed_documents(spark, sf_dir))


def payload_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = inputs.part_result_lines(spark, sf_dir)
    routed = stage(route_results(parse_lines(lines)), "routed")
    entries = word_entries(routed, stage(entry_rows(routed), "entry-rows"))
    return entries.withColumn("translations", F.to_json("translations"))


def result_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = staged_path(spark, "result-documents")
    lines = inputs.part_result_lines(spark, sf_dir).withColumn(
        "file_no", F.expr(f"line_id div {KEYS_PER_FILE}")
    )
    # At most KEYS_PER_FILE results meet in a document.
    results = F.array_sort(F.collect_list(F.struct("line_id", "line")))
    documents = lines.groupBy("source", "file_no").agg(
        F.concat(
            F.lit('{"results":['), F.array_join(results["line"], ","), F.lit('],\n"errors":[7,{"custom_id":"e'),
            F.col("file_no").cast("string"), F.lit('"}]}'),
        ).alias("value")
    )
    documents.write.partitionBy("source", "file_no").text(folder)
    read = stage(read_result_documents(spark, folder), "documents")
    routed = stage(route_results(document_rows(read, "results")), "routed")
    entries = word_entries(routed, stage(entry_rows(routed), "entry-rows"))
    errors = route_errors(document_rows(read, "errors"))
    rows = entries.select("pos", "word", F.to_json("translations").alias("translations")).unionByName(
        errors.select(F.col("line_id").alias("pos"), F.col("custom_id").alias("word"), F.col("error").alias("translations"))
    )
    return rows.groupBy("pos", "word", "translations").agg(F.count(F.lit(1)).alias("n_documents"))


def error_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = staged_path(spark, "error-files")
    custom_id = F.concat(F.lit("request-"), F.col("event_id").cast("string"))
    line = F.to_json(
        F.struct(custom_id.alias("custom_id"), F.struct("event_type").alias("error"))
    )
    cut = F.substr(line, F.lit(1), F.length(line) - 1)
    events = table(spark, sf_dir, "events")
    events.select(F.when(F.col("event_type") == "signup", cut).otherwise(line)).write.text(folder)
    routed = stage(route_errors(parse_lines(read_json_lines(spark, folder))), "routed")
    errors = error_rows(routed).select("custom_id", "type", F.col("error").alias("line"))
    aside = quarantine_rows(routed).select(
        F.lit(None).cast("string").alias("custom_id"), F.col("reason").alias("type"), "line"
    )
    return errors.unionByName(aside)


def untranslated_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_untranslated(inputs.part_entries(spark, sf_dir)).select("p_partkey", "word")


def grammar_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = inputs.part_entries(spark, sf_dir)
    categories = filled_categories(F.col("translations"))
    return entries.select("p_partkey", F.array_join(categories, ",").alias("categories"))


def _processed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = stage(inputs.part_entries(spark, sf_dir), "entries")
    return process_words(entries).drop("p_partkey")


def similar_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _processed_parts(spark, sf_dir).select(
        "source_batch",
        "pos",
        "word",
        F.array_join("similar_words", ",").alias("similar_words"),
        F.array_join("grammar_categories", ",").alias("grammar_categories"),
    )


def similar_words_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents, one sequence per language, with the default distance and neighbours."""
    entries = inputs.text_words(spark, sf_dir).withColumn(
        "translations", F.create_map(F.lit("noun"), F.array(F.reverse("word")))
    )
    found = process_words(entries, sequence="lang").filter(F.size("similar_words") > 0)
    return found.select(
        "lang",
        "pos",
        "word",
        F.size("similar_words").cast("bigint").alias("n_similar"),
        F.md5(F.array_join("similar_words", ",")).alias("similar_words"),
    )


def dictionary_new_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = new_rows(
        inputs.benchmark_words(spark, sf_dir),
        spark.createDataFrame([], "word STRING"),
        ["word"],
        0,
    )
    known = stage(known.withColumn("lang", F.lit("en")), "known")
    candidates = inputs.language_words(spark, sf_dir)
    return new_rows(candidates, known, ["lang", "word"], largest_id(known))


def _children(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    processed = stage(_processed_parts(spark, sf_dir), "processed")
    counts = stage(key_counts(processed, ["word"]), "word-counts")
    known = stage(inputs.part_known_words(spark, sf_dir), "known")
    added = new_words(counts, known, 12, largest_id(known)).select("id", "word")
    rows = with_word_ids(processed, known.unionByName(added), counts)
    return child_rows(number_children(rows, {}))


def dictionary_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _children(spark, sf_dir)["translation"]


def dictionary_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _children(spark, sf_dir)["similar_word"]


def dictionary_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _children(spark, sf_dir)["grammar_category"]


def dictionary_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of batches saved into one dictionary, the first again; each has its own rows."""
    root = staged_path(spark, "dictionary")
    processed = stage(_processed_parts(spark, sf_dir), "processed")
    first = F.col("source_batch") < "Brand#2"
    halves = {"first": processed.filter(first), "second": processed.filter(~first)}
    for half in ("first", "second", "first"):
        save_dictionary(halves[half], root)
    audits = [save_audit(spark, rows, root).withColumn("half", F.lit(half)) for half, rows in halves.items()]
    return audits[0].unionByName(audits[1])


def dictionary_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of a stored dictionary, after rows that break some of them were planted."""
    root = staged_path(spark, "dictionary")
    names = spark.createDataFrame(list(enumerate(LANGUAGES, 1)), "id INT, name STRING")
    for _ in range(2):
        save_languages(names, root)
    save_dictionary(_processed_parts(spark, sf_dir), root)
    planted = table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") - 1000).alias("id"), F.col("n_name").alias("word"), (F.col("n_nationkey") + 30).cast("int").alias("primary_language")
    )
    append_rows(planted, root, "word")
    lost = planted.select(
        "id", F.when(F.col("id") > -990, F.col("id") * 10).otherwise(F.col("id")).alias("word_id"),
        F.when(F.col("id") % 2 == 0, "oddity").otherwise(F.lit("noun")).alias("type"), F.lit("x").alias("translation"),
        F.lit(12).alias("primary_language"), F.lit(99).alias("secondary_language"), F.lit("planted").alias("source_batch"),
    )
    append_rows(lost, root, "translation")
    return dictionary_check(spark, root)


def dictionary_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "part").select(F.col("p_name").alias("word"))
    stored = stored.unionByName(
        table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("word"))
    )
    return word_differences(_processed_parts(spark, sf_dir), stored)


def language_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    names = documents.groupBy(F.col("lang").alias("name")).agg(F.min("doc_id").alias("id"))
    stored = spark.createDataFrame([(1, "en"), (12, "de")], "id INT, name STRING")
    languages = stored.unionByName(seed_languages(names, stored))
    counts = key_counts(documents, ["lang"])
    return languages.join(counts, F.col("name") == F.col("lang")).select(
        F.col("id").cast("bigint").alias("id"), "name", "n_rows"
    )


def language_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = staged_path(spark, "languages")
    # The nation table has 25 rows at every size.
    nations = table(spark, sf_dir, "nation").orderBy("n_nationkey").coalesce(1)
    nations.select(F.concat(F.lit("  "), "n_name", F.lit(" \r\n"))).write.text(folder)
    return read_languages(spark, folder).withColumn("id", F.col("id").cast("bigint"))


def ingest_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What storing the document results leaves in the tables, per source batch."""
    root = staged_path(spark, "dictionary")
    ingest_results(inputs.document_result_lines(spark, sf_dir), root)

    def stored(name: str, kind: str) -> DataFrame:
        return read_table(spark, root, name).groupBy(
            F.lit(name).alias("table_name"), "source_batch", F.expr(kind).alias("kind")
        ).agg(F.count(F.lit(1)).alias("n_rows"))

    words = read_table(spark, root, "word").agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit("word").alias("table_name"),
        F.lit(None).cast("string").alias("source_batch"),
        F.lit(None).cast("string").alias("kind"),
        "n_rows",
    )
    for table_name, kind in (
        ("translation", "type"), ("grammar_category", "category"), ("error", "type"),
        ("quarantine", "reason"), ("similar_word", "CAST(NULL AS STRING)"),
    ):
        words = words.unionByName(stored(table_name, kind))
    return words


def document_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents of results and errors stored in one root, some twice: first with other content.

    The number of the brand and the file picks what is wrong with a document: 1 it is cut off, 2 its
    results are no list, 3 it is null the second time. The last digit of a part's number picks
    the entry: 4 a list of texts is a number, 5 a translation is one text, 6 the line is an error.
    """
    root = staged_path(spark, "dictionary")
    key = F.col("p_partkey")
    digit = key % 10
    custom_id = F.concat(F.lit("request-"), key.cast("string"))
    noun = F.when(digit == 4, F.lit("[1]")).when(digit == 5, F.to_json(F.array("p_type")).substr(F.lit(2), F.length("p_type") + 2))
    entry = F.concat(
        F.lit('{"word":'), F.to_json(F.array("p_name")).substr(F.lit(2), F.length("p_name") + 2), F.lit(',"translations":{"verb":[],"noun":'),
        F.coalesce(noun, F.to_json(F.array("p_type"))), F.lit("}}"),
    )
    content = F.concat(F.lit('{"response":['), entry, F.lit("]}"))
    error = F.when(digit == 6, F.lit("late"))
    lines = table(spark, sf_dir, "part").select(
        "p_brand", key.alias("place"), F.expr(f"p_partkey div {KEYS_PER_FILE}").alias("file_no"), inputs.envelope(custom_id, content, error).alias("line")
    )
    made = lines.groupBy("p_brand", "file_no").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("place", "line")))["line"], ",").alias("results")
    )
    case = (F.substr("p_brand", F.lit(7)).cast("int") + F.col("file_no")) % 10
    whole = F.concat(F.lit('{"errors":[{"custom_id":"e","custom_id":"f"}, 8],"results":['), F.col("results"), F.lit("]}"))
    documents = made.select(F.concat_ws("/", "p_brand", "file_no").alias("source"), case.alias("case"), whole.alias("raw"))
    documents = stage(documents, "documents", **LONG_ROWS)
    ingest_documents(parse_lines(documents.select("source", "raw"), "raw"), root)
    case, raw = F.col("case"), F.col("raw")
    cut = F.when(case == 1, raw.substr(F.lit(1), F.length(raw) - 1)).when(case == 2, F.lit('{"results":"none","errors":[9]}')).when(case == 3, "null")
    ingest_documents(parse_lines(documents.select("source", cut.otherwise(raw).alias("raw")), "raw"), root)

    def stored(name: str, kind: str) -> DataFrame:
        rows = read_table(spark, root, name).groupBy(F.lit(name).alias("table_name"), F.expr(kind).alias("kind"))
        return rows.agg(F.count(F.lit(1)).alias("n_rows"))

    found = stored("word", "CAST(NULL AS STRING)")
    for name, kind in (("translation", "type"), ("grammar_category", "category"), ("error", "concat(type, ' ', origin)"), ("quarantine", "concat(stage, ', ', reason)")):
        found = found.unionByName(stored(name, kind))
    return found


def category_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = (
        F.when(F.col("event_type") == "view", "noun")
        .when(F.col("event_type") == "click", "modal_verb")
        .when(F.col("event_type") == "error", None)
        .otherwise(F.col("event_type"))
    )
    events = table(spark, sf_dir, "events").withColumn("label", label)
    known, strange = split_by_category(events, F.col("label"))
    counted = key_counts(known.withColumn("label", require_category(F.col("label"))), ["label"])
    return counted.withColumn("known", F.lit(True)).unionByName(
        key_counts(strange, ["label"]).withColumn("known", F.lit(False))
    )


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_one(table(spark, sf_dir, "orders"), "o_orderkey", 321).select(
        "o_orderkey", "o_custkey", "o_orderpriority"
    )


def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as status records in files, folded by the streaming job.

    A purchase is two records of the same time, the earlier state of which must not win.
    """
    folder, states = staged_path(spark, "records"), staged_path(spark, "states")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    kinds = F.when(F.col("event_type") == "purchase", F.array(F.lit("completed"), F.lit("finalizing"))).otherwise(
        F.array(F.when(F.col("event_type") == "signup", "expired").otherwise(F.col("event_type")))
    )
    table(spark, sf_dir, "events").withColumn("status", F.explode(kinds)).select(
        F.col("user_id").cast("string").alias("id"),
        "status",
        F.lit(0).alias("created_at"),
        F.when(~F.col("event_type").isin("view"), micros).alias("completed_at"),
        F.when(F.col("status") == "finalizing", micros).alias("finalizing_at"),
        F.when(F.col("event_type") == "view", micros).alias("in_progress_at"),
        F.struct(F.col("event_id").alias("total")).alias("request_counts"),
    ).write.json(folder)
    query = start_status(spark, folder, states, staged_path(spark, "status-checkpoint"))
    query.awaitTermination()
    return read_states(spark, states).select(
        "id", "status", F.col("request_counts.total").alias("event_id"), "outcome"
    )


def unique_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_keys(table(spark, sf_dir, "part"), ["p_name", "p_brand"])


def orphan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers without events, and lines without an order."""

    def check(child: str, key: str, parent: str, parent_key: str) -> DataFrame:
        found = orphans(table(spark, sf_dir, child), key, table(spark, sf_dir, parent), parent_key)
        return found.select(
            F.lit(f"{child}.{key}").alias("foreign_key"), F.col(key).alias("value"), "n_rows"
        )

    return check("orders", "o_custkey", "events", "user_id").unionByName(
        check("lineitem", "l_orderkey", "orders", "o_orderkey")
    )


def domain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    flagged = events.withColumn("category", F.nullif("event_type", F.lit("view")))
    nulls = null_counts(flagged, ["event_id", "category", "value"])
    strange = outside_domain(flagged, "category", ["click", "purchase"])
    return nulls.select(
        F.lit("null").alias("problem"), F.col("column").alias("value"), "n_rows"
    ).unionByName(
        strange.select(F.lit("domain").alias("problem"), F.col("category").alias("value"), "n_rows")
    )


def paged_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(
        table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"),
        {"c_mktsegment": "BUILDING"},
        [F.col("c_name").desc()],
        skip=20,
        take=30,
    )


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return page_after(orders, "o_orderkey", 700, 50)


def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.create_map(
        *[
            F.lit(text)
            for pair in {
                "click": "in_progress", "view": "validating", "purchase": "completed",
                "signup": "cancelled", "error": "error",
            }.items()
            for text in pair
        ]
    )
    records = table(spark, sf_dir, "events").withColumn("status", states[F.col("event_type")])
    return latest_status(records, "user_id", "status", ["ts", "event_id"], ["event_id"])


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result files written, then stored by the streaming job; similar words per file.

    Among the lines are some that are cut off, errors, and entries with an unknown label.
    """
    folder, root = staged_path(spark, "results"), staged_path(spark, "dictionary")
    case = F.col("line_id") % 11
    line = (
        F.when(case == 3, F.concat(F.lit("{"), F.col("line")))
        .when(case == 5, F.concat(F.lit('{"error":{"code":1},"custom_id":"'), F.col("line_id").cast("string"), F.lit('"}')))
        .when(case == 9, F.replace("line", F.lit("adjective"), F.lit("oddity")))
        .otherwise(F.col("line"))
    )
    lines = inputs.part_result_lines(spark, sf_dir).withColumn("line", line)
    lines = lines.withColumn("file_no", F.expr(f"line_id div {KEYS_PER_FILE}"))
    (
        lines.repartition("source", "file_no")
        .sortWithinPartitions("source", "file_no", "line_id")
        .select("source", "file_no", "line")
        .write.partitionBy("source", "file_no")
        .text(folder)
    )
    query = start_ingest(spark, f"{folder}/*/*", root, staged_path(spark, "ingest-checkpoint"))
    query.awaitTermination()
    words = read_table(spark, root, "word").select(F.col("id").alias("word_id"), "word")

    def stored(name: str, kind: str, value: str) -> DataFrame:
        rows = read_table(spark, root, name).join(words, "word_id")
        return rows.groupBy(
            F.lit(name).alias("table_name"), "word", F.expr(kind).alias("kind"),
            F.col(value).alias("value"),
        ).agg(F.count(F.lit(1)).alias("n_rows"))

    def counted(name: str, kind: str) -> DataFrame:
        none = F.lit(None).cast("string")
        rows = read_table(spark, root, name).groupBy(F.lit(name).alias("table_name"), none.alias("word"), F.col(kind).alias("kind"), none.alias("value"))
        return rows.agg(F.count(F.lit(1)).alias("n_rows"))

    return (
        stored("translation", "type", "translation")
        .unionByName(stored("similar_word", "CAST(NULL AS STRING)", "similar_word"))
        .unionByName(stored("grammar_category", "CAST(NULL AS STRING)", "category"))
        .unionByName(counted("error", "type"))
        .unionByName(counted("quarantine", "reason"))
    )


def nested_request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as nested word lists, a request per line of the text; refused documents are told."""
    lists = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
    documents = text_table(spark, sf_dir, "documents").select("doc_id", lists.alias("word_list"))
    lines, refused = decks.nested_requests(documents, ["doc_id"], system_message="sys", answer_schema={"type": "object"})
    return lines.select("doc_id", "request_id", F.md5("line").alias("line")).unionByName(
        refused.select("doc_id", F.lit(-1).cast("bigint").alias("request_id"), F.lit(None).cast("string").alias("line"))
    )


def skipped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows behind the first thousand."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return page(orders, order_by=["o_orderdate", "o_orderkey"], skip=1000).select("o_orderkey", "o_custkey")


def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page from the middle of the largest table, read from the ranges that hold it."""
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    items = table(spark, sf_dir, "lineitem").select(*names)
    return page(items, order_by=names, skip=items.count() // 2, take=50, near_rows=1000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "deck_words": deck_words,
    "subtitle_tokens": subtitle_token_rows,
    "subtitle_files": subtitle_files,
    "conversation_words": conversation_words,
    "corpus_vocabulary": corpus_vocabulary,
    "stopword_filter": stopword_filter,
    "stopword_filter_shuffled": stopword_filter_shuffled,
    "request_packing": request_packing,
    "chunk_list": chunk_list,
    "request_lines": request_lines,
    "request_limits": request_limits,
    "request_files": request_files,
    "wordlist_validation": wordlist_validation,
    "word_list_files": word_list_files,
    "result_routing": result_routing,
    "result_errors": result_errors,
    "quarantine": quarantine,
    "payload_words": payload_words,
    "result_documents": result_documents,
    "error_files": error_files,
    "untranslated_drop": untranslated_drop,
    "grammar_categories": grammar_categories,
    "similar_words": similar_words,
    "similar_words_in_texts": similar_words_in_texts,
    "dictionary_new_words": dictionary_new_words,
    "dictionary_translations": dictionary_translations,
    "dictionary_similar": dictionary_similar,
    "dictionary_categories": dictionary_categories,
    "dictionary_save": dictionary_save,
    "dictionary_check": dictionary_problems,
    "dictionary_differences": dictionary_differences,
    "language_seed": language_seed,
    "language_file": language_file,
    "unique_check": unique_check,
    "orphan_check": orphan_check,
    "domain_check": domain_check,
    "paged_read": paged_read,
    "keyset_page": keyset_page,
    "batch_status": batch_status,
    "ingest_tables": ingest_tables,
    "category_check": category_check,
    "point_lookup": point_lookup,
    "stream_ingest": stream_ingest,
    "stream_status": stream_status,
    "document_ingest": document_ingest,
    "nested_requests": nested_request_lines,
    "skipped_rows": skipped_rows,
    "deep_page": deep_page,
}
