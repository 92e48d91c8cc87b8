import hashlib
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from wordloom.llm.catalog import op10
from wordloom.llm.warc_salvage import arrow_address, list_archives, page_record, read_archives, record_bytes, revisits, salvage, write_archives


def record(i, payload):
    return page_record(i, f"http://x/{i}", payload, hashlib.sha1(payload).hexdigest(), None)


def pages_found(data):
    return [int(x[3]["x-page-id"]) for x in salvage(io.BytesIO(data)) if x[0] == "record"]


def payloads(n=30):
    rng = random.Random(4)
    return [rng.randbytes(rng.choice([0, 5, 3000, 200_000])) for _ in range(n)]


def test_round_trip_and_offsets():
    made = [record(i, p) for i, p in enumerate(payloads())]
    found = list(salvage(io.BytesIO(b"".join(made))))
    assert [x[4] for x in found] == payloads() and [x[2] - x[1] for x in found] == list(map(len, made))


def test_every_damage_costs_only_its_records():
    made = [record(i, p) for i, p in enumerate(payloads(8))]
    whole = b"".join(made)
    rng = random.Random(7)
    begins = [sum(map(len, made[:i])) for i in range(9)]
    for _ in range(60):
        at, size = rng.randrange(len(whole)), rng.choice([1, 4, 300])
        damaged = whole[:at] + bytes(b ^ 0x5A for b in whole[at : at + size]) + whole[at + size :]
        touched = {i for i in range(8) if begins[i] < at + size and at < begins[i + 1]}
        assert set(range(8)) - touched <= set(pages_found(damaged)) <= set(range(8))
        gaps = [x for x in salvage(io.BytesIO(damaged)) if x[0] == "gap"]
        covered = sorted((x[1], x[2]) for x in salvage(io.BytesIO(damaged)))
        assert all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False)) and covered[0][0] == 0 and covered[-1][1] == len(whole)
        assert all(g[3] for g in gaps)


def test_cut_missing_and_foreign_bytes():
    made = [record(i, p) for i, p in enumerate(payloads(6))]
    data = b"junk \x1f\x8b\x08 WARC/1.0" + made[0] + made[1][: len(made[1]) // 2] + made[2] + b"\0" * 5000 + made[3] + made[4][20:] + made[5]
    assert pages_found(data) == [0, 2, 3, 5]
    assert pages_found(b"") == [] and pages_found(b"WARC") == [] and pages_found(b"\x1f") == []


def test_records_that_are_not_compressed():
    import zlib

    plain = [zlib.decompress(record(i, p), 31) for i, p in enumerate(payloads(6))]
    assert pages_found(b"".join(plain)) == [0, 1, 2, 3, 4, 5]
    wrong = plain[1].replace(b"Content-Length: ", b"Content-Length: 9")
    assert pages_found(plain[0] + wrong + plain[2]) == [0, 2]


def test_wrong_lengths_are_not_read():
    class Counting(io.BytesIO):
        n_read = 0

        def read(self, size=-1):
            found = super().read(size)
            Counting.n_read += len(found)
            return found

    plain = [zlib.decompress(record(i, b"x" * 900), 31) for i in range(3000)]
    wrong = [p.replace(b"Content-Length: ", b"Content-Length: 99999") if i % 3 else p for i, p in enumerate(plain)]
    data = b"".join(wrong) * 4
    assert pages_found(data) == [i for i in range(3000) if i % 3 == 0] * 4
    sum(1 for _ in salvage(Counting(data)))
    assert Counting.n_read < 1.1 * len(data)


def test_headers_across_the_end_of_the_buffer():
    plain = [zlib.decompress(record(i, b"x" * 900), 31) for i in range(3000)]
    assert pages_found(b"".join(plain)) == list(range(3000))


def test_names_of_an_object_store():
    assert [arrow_address(x) for x in ("s3a://b/a", "s3n://b", "s3://b", "file:/s3a:/x")] == ["s3://b/a", "s3://b", "s3://b", "file:/s3a:/x"]


def test_digest_is_checked():
    bad = page_record(1, None, b"body", "0" * 40, None)
    found = list(salvage(io.BytesIO(bad + record(2, b"x"))))
    assert [x[0] for x in found] == ["gap", "record"] and found[0][3] == "payload digest differs"


def test_header_values_stay_on_one_line():
    data = record_bytes([("WARC-Type", "response"), ("WARC-Target-URI", "a\r\nX-Page-ID: 9\tb")], b"")
    fields = next(salvage(io.BytesIO(data)))[3]
    assert fields["warc-target-uri"] == "a%0D%0AX-Page-ID: 9%09b" and "x-page-id" not in fields


def test_headers_of_any_length():
    url = "data:text/html," + "x\t" * 100_000
    long = page_record(1, url, b"body", hashlib.sha1(b"body").hexdigest(), None)
    for data in (long + record(2, b"y"), zlib.decompress(long, 31) + zlib.decompress(record(2, b"y"), 31)):
        assert pages_found(data) == [1, 2] and all(x[0] == "record" for x in salvage(io.BytesIO(data)))
    cut = zlib.decompress(long, 31)[:150_000]
    assert pages_found(cut + b"\r\n" + zlib.decompress(record(2, b"y"), 31)) == [2]


def test_every_64_bit_id_comes_back(spark, tmp_path):
    ids, long = [2**63 - 1, 10**18, -(2**63), 10**18 - 1, 0], "<p>a</p>" * 200
    pages = spark.createDataFrame([(i, "u" * 70_000, long) for i in ids], "page_id long, url string, html string")
    archives = write_archives(revisits(pages), str(tmp_path / "warc"))
    found = read_archives(archives).collect()
    assert sorted((r.page_id, r.refers_to, r.gap) for r in found) == sorted((i, None if i == 2**63 - 1 else 2**63 - 1, None) for i in ids)
    assert {r.url for r in found} == {"u" * 70_000}


def test_a_gap_in_archives_of_its_own_ends_the_query(spark, monkeypatch):
    cut = lambda rows, folder: write_archives(rows.withColumn("digest", F.lit("0" * 40)), folder)
    monkeypatch.setattr(op10, "write_archives", cut)
    with pytest.raises(Exception, match="payload digest differs"):
        op10.op10_warc_salvage(spark, "/root/testdata/sf0.001").collect()


def test_jobs(spark, tmp_path):
    long = "<p>é</p>" * 200
    rows = [(1, "u", long), (3, "u", long), (3, "u", long), (2, None, long), (None, "n", long), (4, "s", "short"), (5, "s", "short"), (6, None, None), (7, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    chosen = revisits(pages)
    archives = write_archives(chosen.repartition(2), str(tmp_path / "warc"), archive_bytes=2000)
    listed = archives.collect()
    assert sum(r.records for r in listed) == 9 and len(listed) > 2
    found = read_archives(list_archives(spark, str(tmp_path / "warc"))).collect()
    digest, size = hashlib.sha1(long.encode()).hexdigest(), len(long.encode())
    got = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in found)
    assert got == sorted(
        [("1", "revisit", 3, size), ("2", "revisit", 3, size), ("None", "revisit", 3, size), ("3", "response", None, size), ("3", "response", None, size)]
        + [("4", "response", None, 5), ("5", "response", None, 5), ("6", "response", None, 0), ("7", "response", None, 0)]
    )
    assert {r.payload_digest for r in found if r.payload_bytes == size} == {digest}
    assert {bytes(r.payload) for r in found if r.page_id == 3} == {long.encode()} and all(r.gap is None for r in found)
    assert write_archives(revisits(pages.limit(0)), str(tmp_path / "none")).count() == 0


def test_a_damaged_archive_in_a_job(spark, tmp_path):
    made = [record(i, p) for i, p in enumerate(payloads(5))]
    (tmp_path / "a.warc.gz").write_bytes(made[0] + made[1][:-9] + made[2])
    found = read_archives(list_archives(spark, str(tmp_path))).orderBy("start").collect()
    assert [r.page_id for r in found] == [0, None, 2] and [r.gap is None for r in found] == [True, False, True]
    assert (found[1].start, found[1].stop) == (len(made[0]), len(made[0]) + len(made[1]) - 9)
