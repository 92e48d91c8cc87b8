import zlib
from collections import defaultdict
from random import Random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wordloom.llm.catalog.op04 import op4_vector_packing
from wordloom.llm.common import read_table
from wordloom.llm.vector_packing import Packer, pack_documents

SF_DIR = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def check_pieces(pieces, lengths):
    """Every token in one piece; offsets without gaps."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, start, length, sequence, offset in pieces:
        by_doc[doc].append((start, length))
        by_sequence[sequence].append((offset, length, doc, start))
    assert set(by_doc) == {d for d, n in lengths.items() if n}
    for doc, parts in by_doc.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == lengths[doc]
    for parts in by_sequence.values():
        at = 0
        for offset, length, _, _ in sorted(parts):
            assert offset == at
            at += length
    return by_sequence


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 70), st.integers(0, 80)), max_size=60),
    st.tuples(st.integers(1, 32), st.integers(1, 5), st.integers(1, 32)),
    st.integers(1, 200),
)
def test_limits_hold(docs, limits, window):
    packer = Packer(limits, 0, window)
    for i, (length, loss_from) in enumerate(docs):
        if length:
            packer.add(i, 0, length, loss_from)
    packer.pack()
    pieces = packer.taken()
    for parts in check_pieces(pieces, {i: n for i, (n, _) in enumerate(docs)}).values():
        loss = sum(max(0, min(length, start + length - docs[doc][1])) for _, length, doc, start in parts)
        assert sum(p[1] for p in parts) <= limits[0] and len(parts) <= limits[1] and loss <= limits[2]


def test_dot_product_takes_what_fits_the_room_best():
    packer = Packer((100, 10, 20), 0)
    for i, (length, loss) in enumerate([(60, 20), (60, 0), (40, 20), (40, 0)]):
        packer.add(i, 0, length, length - loss)
    packer.pack()
    sequences = defaultdict(set)
    for doc, _, _, sequence, _ in packer.taken():
        sequences[sequence].add(doc)
    # The heaviest piece takes all loss tokens; the one without any fills the room beside it.
    assert sequences[0] == {0, 3}


@pytest.mark.parametrize("loss_share", [1, 0.5])
def test_many_tiny_documents_need_little_padding(loss_share):
    """Segments run out long before the tokens: such sequences end at powers of two."""
    draw = Random(5)
    lengths = {i: draw.randint(3, 9) for i in range(20_000)}
    bears = {i: int(n * (1 - loss_share)) for i, n in lengths.items()}
    packer = Packer((2048, 64, 1024), 0)
    for i, n in lengths.items():
        packer.add(i, 0, n, bears[i])
    packer.pack()
    sequences = check_pieces(packer.taken(), lengths)
    used = [sum(p[1] for p in parts) for parts in sequences.values()]
    assert all(len(parts) <= 64 for parts in sequences.values())
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in used) < 0.01 * sum(used)
    assert len(used) < 1.5 * 20_000 * 6 / 256


def test_tiny_documents_beside_long_ones():
    draw = Random(6)
    lengths = {i: draw.randint(3, 9) if i % 3 else draw.randint(10, 6000) for i in range(5_000)}
    packer = Packer((2048, 64, 2048), 0, 100_000)
    for i, n in lengths.items():
        packer.add(i, 0, n, 0)
    packer.pack()
    used = [sum(p[1] for p in parts) for parts in check_pieces(packer.taken(), lengths).values()]
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in used) < 0.01 * sum(used)


def test_query(spark):
    docs = {r.doc_id: r.text or "" for r in read_table(spark, SF_DIR, "documents").collect()}
    tokenizer = Tokenizer.from_file(WORDS)
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in docs.items()}
    rows = op4_vector_packing(spark, SF_DIR).collect()
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    sequences = check_pieces([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in rows], {d: len(x) for d, x in ids.items()})
    used = [sum(p[1] for p in parts) for parts in sequences.values()]
    assert max(used) <= 2048
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in used)
    assert padding < 0.01 * sum(used)


def test_nulls_repeats_clashes_and_no_rows(spark):
    rows = [(1, None, 5, "a"), (1, None, 5, "a"), (None, "some words", None, "b"), (2, "", 9, None), (3, "long text " * 400, 2, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, loss int, start string")
    found = pack_documents(docs, WORDS, 1, loss_from_col="loss", max_tokens=64, max_segments=3, max_loss_tokens=50).collect()
    assert sorted((str(r.doc_id), r.doc_tokens) for r in found if r.start == 0) == [("1", 1), ("1", 1), ("2", 1), ("3", 801), ("None", 3)]
    assert all(len(r.ids) == 4 * r.length for r in found)
    assert pack_documents(docs.limit(0), WORDS, 1).count() == 0
    assert {r.doc_id for r in pack_documents(docs, WORDS, None).collect()} == {None, 3}
    with pytest.raises(ValueError):
        pack_documents(docs, WORDS, 1, max_segments=0)
