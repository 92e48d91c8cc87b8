import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wordloom.llm.common import read_table
from wordloom.llm.catalog.op07 import op7_token_files
from wordloom.llm.token_files import checksums, read_token_files, with_starts, write_token_files
from wordloom.llm.tokenizing import TextEncoder

SF_DIR = "/root/testdata/sf0.001"
BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
ODD = [
    "", " ", "\n", "a", "a ", " a", "a\n", "\na", "a  b", "a \nb", "a\n b", "a\n\nb", "a\n\n\nb", "a\n\n", "a\tb　c", "don't we'll 12 34ab",
    "x <|endoftext|> y <|", "é é ́a", "İ ΣΑΣ ß", "​ab c", "a\x00b", "🙂 👩‍👩‍👧 ok", "word " * 3000,
]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_give_the_ids_of_the_whole_text(path):
    encoder, plain = TextEncoder(path), Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    random = np.random.default_rng(1)
    signs = list(" \n  ab'st1.\té　x<|éß")
    texts = ODD + ["".join(random.choice(signs, random.integers(0, 40))) for _ in range(400)]
    for _ in range(2):  # new pieces, then known ones
        ids, starts = encoder.encode(texts, 5)
        for i, text in enumerate(texts):
            assert ids[starts[i] : starts[i + 1]].tolist() == [*plain.encode(text, add_special_tokens=False).ids, 5]


def test_a_full_table_is_trimmed(monkeypatch):
    import wordloom.llm.tokenizing as t

    monkeypatch.setattr(t, "CACHED_PIECES", 10)
    encoder = TextEncoder(BYTES)
    texts = [f"word{i} and{i} more" for i in range(30)]
    ids = [encoder.encode([x])[0].tolist() for x in texts]
    assert len(encoder.table.slots) <= 10 + 4 and ids == [TextEncoder(BYTES).whole(x).tolist() for x in texts]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_a_repeated_piece_is_looked_up_once(path, monkeypatch):
    looked_up, plain = [], TextEncoder._slots
    monkeypatch.setattr(TextEncoder, "_slots", lambda self, pieces: looked_up.extend(pieces) or plain(self, pieces))
    encoder = TextEncoder(path)
    encoder.encode(["new words"], 5)
    looked_up.clear()
    texts = ["new words " * 100 + "new", "", "new\nwords"] * 20
    ids, starts = encoder.encode(texts, 5)
    assert len(looked_up) <= 2 * 6
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == [[*encoder.whole(x).tolist(), 5] for x in texts]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_only_texts_that_are_cut_nowhere(path):
    for texts in ([], ["x <| y"], ["", ""], ["a\tb", "a"]):
        for end in (None, 5):
            encoder = TextEncoder(path)
            ids, starts = encoder.encode(texts, end)
            want = [[*encoder.whole(x).tolist(), *([] if end is None else [end])] for x in texts]
            assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == want


def expected(docs):
    plain, start, out = Tokenizer.from_file(BYTES), 0, []
    plain.encode_special_tokens = True
    for row in sorted(docs, key=lambda r: r.doc_id):
        ids = [*plain.encode(row.text or "", add_special_tokens=False).ids, 2]
        out.append((row.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_plain_encoding(spark):
    docs = read_table(spark, SF_DIR, "documents").collect()
    found = [tuple(r) for r in op7_token_files(spark, SF_DIR).orderBy("doc_id").collect()]
    assert found == expected(docs)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files(spark, tmp_path, encoding):
    path = str(tmp_path / "tokens")
    docs = spark.range(600).select(
        (600 - F.col("id")).alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"), F.lit(1).alias("place")
    )
    write_token_files(docs.repartition(3), path, BYTES, 2, encoding=encoding, row_group_bytes=4096, page_rows=50)
    files = sorted((tmp_path / "tokens").glob("*.parquet"))
    last = 0
    for file in files:
        meta = pq.ParquetFile(file).metadata
        tokens = meta.row_group(0).column(3)
        assert tokens.path_in_schema == "tokens.list.element" and tokens.has_offset_index
        assert ("RLE_DICTIONARY" in tokens.encodings) == (encoding == "dictionary")
        assert encoding == "dictionary" or "DELTA_BINARY_PACKED" in tokens.encodings
        ids = pq.read_table(file).column("doc_id").to_pylist()
        assert ids == sorted(ids) and (not ids or ids[0] > last)
        last = ids[-1] if ids else last
    read = read_token_files(spark, path)
    few = read.where("doc_id = 7").select("tokens").collect()
    assert few[0].tokens == [*Tokenizer.from_file(BYTES).encode("some words 593").ids, 2]


def test_nulls_repeats_and_no_rows(spark, tmp_path):
    rows = [(2, "b"), (2, "b"), (2, "a"), (None, "c"), (1, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    write_token_files(docs, str(tmp_path / "a"), BYTES, 2)
    found = with_starts(checksums(read_token_files(spark, str(tmp_path / "a")))).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, 1, 2, 2, 2, 3]
    assert [r.n_tokens for r in found] == [2, 1, 2, 2, 2, 1] and [r.start for r in found] == [0, 2, 3, 5, 7, 9]
    write_token_files(docs.limit(0), str(tmp_path / "b"), BYTES, 2)
    assert with_starts(checksums(read_token_files(spark, str(tmp_path / "b")))).count() == 0
    with pytest.raises(ValueError):
        write_token_files(docs, str(tmp_path / "c"), BYTES, 2, encoding="other")
