import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from wordloom.llm.catalog.op12 import op12_merkle_manifest
from wordloom.llm.merkle import fold, manifest, siblings_hash

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    values = [doc_id, source, lang, n_chars, text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(nodes, width):
    """Root of the nodes, and the siblings (before, after) of each on its way there."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + width] for i in range(0, len(nodes), width)]
        for path, i in zip(paths, at, strict=True):
            run, k = runs[i // width], i % width
            path.append(("".join(run[:k]), "".join(run[k + 1 :])))
        nodes, at = [digest("".join(r)) for r in runs], [i // width for i in at]
    return nodes[0], paths


def brute(docs, width=2):
    groups = {}
    for row in docs:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(*row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    out, roots = [], []
    for name in names:
        rows = sorted(groups[name], key=lambda r: r[:3])
        root, paths = climbed([r[2] for r in rows], width)
        roots.append(root)
        out.append((rows, paths))
    whole, tops = climbed(roots, width)
    found = []
    for (rows, paths), root, top in zip(out, roots, tops, strict=True):
        for (_, _, own, row), path in zip(rows, paths, strict=True):
            start, steps = own, path + top
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0:
                start = leaf(row[0], row[1], row[2], row[3], None if row[4] is None else row[4] + 1)
            for before, after in steps:
                start = digest(before + start + after)
            found.append((row[0], own, root, whole, digest("".join(b + a for b, a in steps)), start, start == whole))
    return sorted(found, key=repr)


def made(df, **options):
    changed = F.crc32(F.col("id").cast("string").cast("binary")) % 7 == 0
    found = manifest(df, changed, **options)
    folded = fold(F.coalesce("other_leaf", "leaf"), F.col("path"))
    rows = found.select("id", "leaf", "subroot", "root", siblings_hash(F.col("path")), folded, folded == F.col("root"))
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def docs(sizes, seed=0):
    rnd = random.Random(seed)
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            text = rnd.choice([None, "", "ä:1", "x" * rnd.randint(1, 50)])
            rows.append((rnd.randint(-500, 10**12), text, lang, rnd.choice([None, "web", "ü"]), rnd.choice([None, 0, 7, 2**63 - 1])))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    ("sizes", "width", "levels"),
    [
        ({"en": 1}, 2, 2),
        ({"en": 2, None: 1, "": 3, "é": 5, "z": 4}, 2, 2),
        ({"en": 37, "de": 16, "fr": 17, None: 8}, 2, 2),
        ({"en": 66, "de": 1}, 2, 3),
        ({"en": 30, "de": 9, "fr": 10, "es": 1, "it": 2}, 3, 2),
        ({f"l{i}": 1 + i % 3 for i in range(11)}, 2, 1),
    ],
)
def test_same_as_brute_force(spark, sizes, width, levels):
    rows = docs(sizes, len(sizes))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert made(df, fan_out=width, levels=levels) == brute(rows, width)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (1, "b", "en", "s", 1), (None, "n", "en", None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("tree", "rank", "n", "hash", "item", "path", "root", "id", "group"):
        df = df.withColumn(name, F.lit("x"))
    assert made(df) == brute(rows)


def test_empty_table(spark):
    assert made(spark.createDataFrame([], SCHEMA)) == []


def test_one_changed_text_changes_the_root(spark):
    rows = docs({"en": 20, "de": 5}, 3)
    whole = {r[3] for r in made(spark.createDataFrame(rows, SCHEMA))}
    other = {r[3] for r in made(spark.createDataFrame([(*rows[0][:1], "changed", *rows[0][2:]), *rows[1:]], SCHEMA))}
    assert len(whole) == len(other) == 1 and whole != other


def test_whole_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    found = op12_merkle_manifest(spark, sf_dir)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows)
