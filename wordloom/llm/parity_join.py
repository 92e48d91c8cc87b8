"""Near-duplicate classes of documents by a join of parity sketches.

Blocks of parity sketches are the join keys: two documents that link agree in blocks of their band of
sizes (see ``parity_sketch``). In a bucket every document is compared with one centre, the one
that meets most others; what that leaves apart is compared among itself. Sizes and short sketches
drop pairs by an exact bound, the shingle sets decide. Only links are kept, and only as components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.common import id_type, keyed_text, map_batches, whole_rows
from wordloom.llm.components import components
from wordloom.llm.parity_sketch import SHARE, SHORT_BITS, block_keys, folded, linked, may_link, mixed, set_key, shingles, sketch
from wordloom.llm.words import spaced_words
from wordloom.session import stage

LARGE_BUCKET = 2_000  # documents of a bucket that are still apart and are compared in one task
KEYS_AT_ONCE = 500_000  # block keys that a task sorts at once; sorting takes some 80 bytes for each
TEXTS_AT_ONCE = 1_000  # texts of a batch that are Python objects at once
DENSE = 16  # pairs per document that one bucket may hand out in a round
BROADCAST_IDS = 1_000_000  # ids that may be broadcast after they were counted


def values_of(column: pa.Array) -> Iterator[bytes | None]:
    """The values one after the other, made in small blocks: a batch holds thousands of texts."""
    for at in range(0, len(column), TEXTS_AT_ONCE):
        yield from column.slice(at, TEXTS_AT_ONCE).to_pylist()


def described(rows: DataFrame) -> DataFrame:
    """``id, n, cls, sketch`` of ``id, text``; without words ``n`` is 0 and the others null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, sketches = [], [], []
            for text in values_of(batch.column(1)):
                found = shingles(spaced_words(text)) if text else ()
                sizes.append(len(found))
                keys.append(set_key(found) if len(found) else None)
                sketches.append(sketch(found) if len(found) else None)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "cls", "sketch"])

    return map_batches(rows, work, f"id {id_type(rows)}, n bigint, cls bigint, sketch binary")


def bucketed(rows: DataFrame) -> DataFrame:
    """``spread, cls, bucket`` of ``id, text``: the block keys of every set, once per task for equal sets.

    Rows are shuffled by ``spread``. Of the sets of a task that share a bucket only the first takes the bucket itself as
    ``spread``; the others go anywhere. So no bucket sends more rows to one place than tasks
    have blocks of ``KEYS_AT_ONCE``. ``bucket`` is
    given where the bucket is known to hold two sets, else it is null and the same as ``spread``.
    """

    def flushed(keys: list[np.ndarray], owners: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        bucket, cls = np.concatenate(keys), np.concatenate(owners)
        _, first, which, count = np.unique(bucket, return_index=True, return_inverse=True, return_counts=True)
        alone = count[which] == 1
        spread = mixed((bucket ^ cls).view(np.uint64)).view(np.int64)
        spread[first] = bucket[first]
        # In the order of the sets: neighbours have the same set, which packs well.
        for at in range(0, len(bucket), 100_000):
            part = slice(at, at + 100_000)
            columns = [pa.array(spread[part]), pa.array(cls[part]), pa.array(bucket[part], mask=alone[part])]
            yield pa.RecordBatch.from_arrays(columns, names=["spread", "cls", "bucket"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, owners, size = [], [], 0
        for batch in batches:
            for text in values_of(batch.column(1)):
                found = shingles(spaced_words(text)) if text else ()
                if len(found) < SHARE[0] or (cls := set_key(found)) in seen:
                    continue
                seen.add(cls)
                keys.append(block_keys(found))
                owners.append(np.full(len(keys[-1]), cls, np.int64))
                size += len(keys[-1])
                if size >= KEYS_AT_ONCE:
                    yield from flushed(keys, owners)
                    keys, owners, size = [], [], 0
        if keys:
            yield from flushed(keys, owners)

    return map_batches(rows, work, "spread bigint, cls bigint, bucket bigint")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """``bucket, cls`` of the buckets with two classes or more, without repeats; one shuffle of small rows."""
    same = Window.partitionBy("spread")
    ends = rows.repartition("spread").select("spread", "cls", "bucket", F.min("cls").over(same).alias("low"), F.max("cls").over(same).alias("high"))
    return ends.where("bucket is not null or low < high").select(F.coalesce("bucket", "spread").alias("bucket"), "cls").distinct()


def with_class(rows: DataFrame, classes: DataFrame, key: str, prefix: str) -> DataFrame:
    wanted = classes.select(F.col("cls").alias("of"), *(F.col(c).alias(f"{prefix}{c}") for c in ("n", "sketch")))
    return rows.join(wanted, F.col(key) == F.col("of")).drop("of")


def star_pairs(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b``: the members of every bucket with its centre ``b``, where the bounds allow a link."""
    pairs = shared.where("cls <> centre").select(F.col("cls").alias("a"), F.col("centre").alias("b")).distinct()
    sized = with_class(with_class(pairs, classes, "a", "a_"), classes, "b", "b_")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = (batch.column(c).to_pylist() for c in ("a_n", "b_n", "a_sketch", "b_sketch"))
            yield batch.select(["a", "b"]).filter(pa.array([may_link(*x) for x in zip(*values, strict=True)], pa.bool_()))

    return map_batches(sized, work, "a bigint, b bigint")


def with_centres(rows: DataFrame) -> DataFrame:
    """Add the centre of each bucket: the class that meets most others in all its buckets; ties: the largest key."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).withColumnRenamed("bucket", "of")
    met = rows.join(sizes, F.col("bucket") == F.col("of")).groupBy("cls").agg(F.sum("size").alias("met")).withColumnRenamed("cls", "of")
    ranked = rows.join(met, F.col("cls") == F.col("of")).groupBy("bucket").agg(F.max(F.struct("met", "cls")).alias("top"))
    centres = ranked.select(F.col("bucket").alias("of"), F.col("top.cls").alias("centre"))
    return rows.join(centres, F.col("bucket") == F.col("of")).drop("of")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose sets link. Each side meets its text in a join that Spark can split where one class is frequent."""
    first = pairs.join(texts.select(F.col("cls").alias("of"), F.col("text").alias("text_a")), F.col("a") == F.col("of")).drop("of")
    both = first.join(texts.select(F.col("cls").alias("of"), F.col("text").alias("text_b")), F.col("b") == F.col("of")).drop("of")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            yes = []
            for b, text_a, text_b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if b != last:
                    last, last_set = b, shingles(spaced_words(text_b))
                yes.append(linked(shingles(spaced_words(text_a)), last_set))
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return map_batches(both.select("a", "b", "text_a", "text_b"), work, "a bigint, b bigint")


def _bucket_pairs(cls: np.ndarray, comp: np.ndarray, n: np.ndarray, sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different components that the bounds allow; and the places of members whose pairs are not all given.

    Where the pairs are many (a cluster that is not joined yet), only those with the few members that have most are given:
    they join the cluster, and the rest is for the next round.
    """
    part, whole = SHARE
    size = len(cls)
    short = np.array([folded(np.frombuffer(x, np.uint64), SHORT_BITS // 64) for x in sketches])
    first, second = [], []
    for at in range(0, size, 256):
        rows = slice(at, min(at + 256, size))
        near = (comp[rows, None] != comp[None, :]) & (np.arange(size)[None, :] > np.arange(size)[rows, None])
        near &= np.minimum(n[rows, None], n[None, :]) * whole >= np.maximum(n[rows, None], n[None, :]) * part
        i, j = np.nonzero(near)
        differ = np.bitwise_count(short[rows][i] ^ short[j]).sum(axis=1, dtype=np.int64)
        keep = differ * (whole + part) <= (n[rows][i] + n[j]) * (whole - part)
        keep[keep] = [may_link(n[a], n[b], sketches[a], sketches[b]) for a, b in zip((i[keep] + at).tolist(), j[keep].tolist(), strict=True)]
        first.append(i[keep] + at)
        second.append(j[keep])
    a, b = np.concatenate(first), np.concatenate(second)
    if len(a) <= DENSE * size:
        return a, b, np.zeros(0, np.int64)
    degree = np.bincount(a, minlength=size) + np.bincount(b, minlength=size)
    top = np.argsort(-degree, kind="stable")[: max(1, DENSE // 2)]
    is_top = np.zeros(size, bool)
    is_top[top] = True
    keep = is_top[a] | is_top[b]
    left = np.unique(np.concatenate([a[~keep], b[~keep]]))
    return a[keep], b[keep], left


def pairs_apart(rows: DataFrame) -> DataFrame:
    """``left, a, b`` from ``bucket, cls, comp, n, sketch``: pairs (``left`` false), and rows ``bucket, cls`` for another round."""

    def settled(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        bucket, cls, comp, n = (table.column(c).to_numpy() for c in ("bucket", "cls", "comp", "n"))
        sketches = table.column("sketch").to_pylist()
        edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        kinds, firsts, seconds = [], [], []
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            own = cls[start:stop]
            a, b, left = _bucket_pairs(own, comp[start:stop], n[start:stop], sketches[start:stop])
            kinds += [np.zeros(len(a), bool), np.ones(len(left), bool)]
            firsts += [own[a], np.full(len(left), bucket[start])]
            seconds += [own[b], own[left]]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (kinds, firsts, seconds)], names=["left", "a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of a bucket may go on in the next batch
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            if not len(bucket):
                continue
            last = int(np.searchsorted(bucket, bucket[-1]))
            if held and (last or bucket[0] != held[-1].column(0)[0].as_py()):
                yield settled([*held, batch.slice(0, last)] if last else held)
                held = []
            elif last:
                yield settled([batch.slice(0, last)])
            held.append(batch.slice(last))
        if held:
            yield settled(held)

    ordered = rows.select("bucket", "cls", "comp", "n", "sketch").repartition("bucket").sortWithinPartitions("bucket", "cls")
    return map_batches(ordered, work, "left boolean, a bigint, b bigint")


def refined(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of large buckets under keys of two blocks: linked sets that share one block share another."""
    joined = rows.select("bucket", "cls").join(texts.select(F.col("cls").alias("of"), "text"), F.col("cls") == F.col("of")).select("bucket", "cls", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, cls, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = block_keys(shingles(spaced_words(text)))
                keys = keys[keys != bucket]
                yield pa.RecordBatch.from_arrays([pa.array(keys * np.int64(2654435761) ^ np.int64(bucket)), pa.array(np.full(len(keys), cls, np.int64))], names=["bucket", "cls"])

    keyed = map_batches(joined, work, "bucket bigint, cls bigint")
    return keyed.select(F.col("bucket").alias("spread"), "cls", F.lit(None).cast("bigint").alias("bucket"))


def still_apart(shared: DataFrame, found: DataFrame) -> DataFrame:
    """``bucket, cls, comp`` of buckets whose members are in different components."""
    comps = found.withColumnRenamed("node", "of")
    rows = shared.join(comps, F.col("cls") == F.col("of"), "left").select("bucket", "cls", F.coalesce("component", "cls").alias("comp"))
    apart = rows.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).where("low < high")
    return rows.join(apart.select(F.col("bucket").alias("of"), "size"), F.col("bucket") == F.col("of")).drop("of")


def dealt(rows: DataFrame, large_bucket: int) -> DataFrame:
    """``bucket, cls, comp`` of large buckets with their ``size``, as cells: any two rows of a bucket meet in one of them.

    A bucket's rows are dealt to parts by hash, and each two parts are a cell, so that no task holds a whole bucket.
    """
    parts = F.ceil(F.col("size") * 3 / large_bucket).cast("int")
    own = rows.withColumn("part", F.pmod(F.xxhash64("cls", "bucket"), parts).cast("int"))
    met = own.select("bucket", "cls", "comp", "part", F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")).where("part <> other")
    return met.select(F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")).alias("bucket"), "cls", "comp")


def by_id(docs: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Join by id: with a broadcast of the ids when they are few as counted, else by a shuffle."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, key, how)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    large_bucket: int = LARGE_BUCKET,
) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per document.

    ``n_shingles``: distinct shingles of five words (``SHINGLE_WORDS``), by 64-bit hashes. ``component_id``: the smallest id that links
    reach, where two documents link when 5 x intersection >= 4 x union (``SHARE``). Null, empty and blank texts link with
    nothing and have their own id. Repeated rows and equal sets are one class. A row without an id belongs to the class of its set, as
    far as rows with an id have that set. An empty table gives no rows. Texts of any length are cut into shingles whole.
    Other columns are not read. No link is lost: see ``parity_sketch.block_keys``.
    """
    rows = keyed_text(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    known = stage(described(rows), "sets")
    made = known.where("cls is not null").groupBy("cls").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = stage(made, "classes")

    shared = stage(with_centres(stage(shared_buckets(bucketed(rows)), "buckets")), "centres")
    pairs = stage(star_pairs(shared, classes), "pairs")
    links = stage(verified(pairs, class_texts(rows, classes, pairs)), "verified")
    found = stage(components(links), "components")
    # What stars left apart, until no bucket holds a pair that the bounds allow.
    state = shared.where("cls <> centre").select("bucket", "cls")
    first = True
    while True:
        apart = stage(still_apart(state, found), "apart")
        if first:
            large = apart.where(F.col("size") > large_bucket)
            if not large.isEmpty():
                again = stage(still_apart(shared_buckets(refined(large, class_texts(rows, classes, large.select("cls")))), found), "refined")
                small = apart.unionByName(again).where(F.col("size") <= large_bucket).select("bucket", "cls", "comp")
                # Two whole blocks is all that linked sets surely share, so a third would lose links.
                apart = stage(small.unionByName(dealt(again.where(F.col("size") > large_bucket), large_bucket)), "apart")
            first = False
        tried = stage(pairs_apart(with_class(apart.select("bucket", "cls", "comp"), classes, "cls", "")), "tried")
        more = stage(tried.where("not left").select("a", "b").distinct(), "pairs")
        if more.isEmpty():
            break
        new = stage(verified(more, class_texts(rows, classes, more)), "verified")
        if not new.isEmpty():
            links = links.unionByName(new)
            found = stage(components(links), "components")
        state = tried.where("left").select(F.col("a").alias("bucket"), F.col("b").alias("cls"))
        if state.isEmpty():
            break

    smallest = classes.join(found.withColumnRenamed("node", "of"), F.col("cls") == F.col("of"), "left")
    grouped = smallest.select("cls", "rep", F.coalesce("component", "cls").alias("component"))
    lowest = grouped.groupBy("component").agg(F.min("rep").alias("lowest")).withColumnRenamed("component", "of")
    named = grouped.join(lowest, F.col("component") == F.col("of")).select(F.col("cls").alias("of"), "lowest")
    result = known.select("id", "n", "cls").join(named, F.col("cls") == F.col("of"), "left")
    return result.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("lowest", "id").alias("component_id"))


def class_texts(rows: DataFrame, classes: DataFrame, named: DataFrame) -> DataFrame:
    """``cls, text`` of the classes in the columns of ``named``, staged; the text is that of the class's smallest id."""
    keys = named.select(F.explode(F.array(*named.columns)).alias("cls")).distinct()
    wanted = classes.join(keys, "cls", "left_semi").where("rep is not null").select(F.col("rep").alias("id"), F.col("cls").alias("of"))
    return stage(matching_texts(by_id(rows.where("id is not null"), stage(wanted, "wanted"), "id", "inner")), "texts")


def matching_texts(rows: DataFrame) -> DataFrame:
    """``cls, text`` of ``id, text, of`` where the text's set is the class: an id may have several texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts, classes = batch.column(0), batch.column(1).to_pylist()
            keep = []
            for text, cls in zip(values_of(texts), classes, strict=True):
                fits = text is not None and cls not in seen and set_key(shingles(spaced_words(text))) == cls
                seen.update([cls] * fits)
                keep.append(fits)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(mask), texts.filter(mask)], names=["cls", "text"])

    return map_batches(rows.select("text", "of"), work, "cls bigint, text binary")


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that have a near-duplicate with a smaller id. Columns stay as they are.

    Rows without an id stay. Of rows that repeat an id and a text one stays; an id with several texts goes only when all
    of them go. Null and empty texts stay. An empty table gives no rows.
    """
    found = stage(near_duplicates(docs, id_col, text_col).where("doc_id is not null"), "classes-of-documents")
    apart = (F.col("doc_id") != F.col("component_id")).cast("int")
    by_document = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(apart).alias("gone"))
    marked = stage(by_document.where("gone = 1 or n > 1").withColumnRenamed("doc_id", "id"), "documents-to-drop")
    rows = whole_rows(docs, text_col)
    rows = rows.withColumn("id", F.col("row")[id_col])
    kept = by_id(rows, marked.where("gone = 1").select("id"), "id", "left_anti")
    repeated = marked.where("gone = 0").select("id")
    if not repeated.isEmpty():
        single = by_id(kept, repeated, "id", "left_anti")
        kept = single.unionByName(by_id(kept, repeated, "id", "left_semi").dropDuplicates(["id", "text"]))
    return kept.select("row.*")
