import json

import pytest
from pyspark.sql import functions as F

from wordloom.operators.checks import duplicate_keys, null_counts, orphans, outside_domain
from wordloom.operators.paging import OrderedRanges, find_one, page, page_after
from wordloom.operators.status import latest_status
from wordloom.schemas import BATCH_RECORD, FILE_RECORD
from wordloom.streaming.status import compact_states, fold_records, read_states, start_status


@pytest.fixture
def users(spark):
    rows = [(1, "a@x", "Ann", True), (2, "b@x", "Bob", False), (3, "a@x", None, False),
            (4, None, "Dan", False), (5, None, "Eve", True)]
    return spark.createDataFrame(rows, "id INT, email STRING, name STRING, is_admin BOOLEAN")


def test_constraints(spark, users):
    assert [tuple(r) for r in duplicate_keys(users, ["email"]).collect()] == [("a@x", 2)]
    assert {tuple(r) for r in null_counts(users, ["id", "email", "name"]).collect()} == {
        ("email", 2), ("name", 1)}
    child = spark.createDataFrame([(1,), (9,), (9,), (None,)], "user_id INT")
    assert [tuple(r) for r in orphans(child, "user_id", users, "id").collect()] == [(9, 2)]
    got = outside_domain(users, "name", ["Ann", "Bob", "Dan"]).collect()
    assert [tuple(r) for r in got] == [("Eve", 1)]


def test_pages(users):
    def ids(df):
        return [r.id for r in df.collect()]

    assert ids(page(users, {"is_admin": False}, ["id"], skip=1, take=1)) == [3]
    assert ids(page(users, {"email": None}, [F.col("id").desc()])) == [5, 4]
    assert ids(page(users, order_by=["id"], skip=4)) == [5]
    assert ids(page_after(users, "id", size=2)) == [1, 2]
    assert ids(page_after(users, "id", 2, 2)) == [3, 4]
    assert ids(page_after(users, "id", 5, 2)) == []
    assert ids(find_one(users, "id", 2)) == [2] and ids(find_one(users, "id", 9)) == []


@pytest.mark.parametrize("order", [
    lambda: ["k", "id"], lambda: [F.col("k").desc(), "id"], lambda: [F.col("k").asc_nulls_last(), F.col("id").desc()]])
def test_deep_pages(spark, order):
    order = order()
    rows = spark.range(3000).select(F.when(F.col("id") % 11 > 0, F.col("id") * 7 % 50).alias("k"), "id")
    want = [tuple(r) for r in rows.orderBy(*order).collect()]
    ranges = OrderedRanges(rows, order, 8)
    assert len(ranges) == 3000 and len(ranges.starts) > 1
    for skip, take in ((0, 5), (1490, 30), (990, 1200), (2995, 50), (3000, 10), (0, 3000), (7, 0)):
        assert [tuple(r) for r in ranges.page(skip, take).collect()] == want[skip : skip + take]
    assert [tuple(r) for r in page(rows, {"k": 7}, ["id"], skip=20, take=10, near_rows=5).collect()] == [
        x for x in sorted(want, key=lambda x: x[1]) if x[0] == 7][20:30]
    assert page(rows.limit(0), order_by=order, skip=9, take=9, near_rows=5).collect() == []
    assert len(page(rows, skip=9, take=9, near_rows=5).collect()) == 9


def test_deep_pages_read_few_ranges(spark):
    found = page(spark.range(60_000), order_by=["id"], skip=30_000, take=20)
    assert [r.id for r in found.collect()] == list(range(30_000, 30_020))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan and "PartitionFilters: [isnotnull(_range" in plan
    held = OrderedRanges(spark.range(60_000), ["id"], 12)
    assert len(held.starts) == 12 and sum(start < 30_020 and end > 30_000 for _, start, end in held.starts) <= 2


def test_outcomes(spark):
    states = ["failed", "error", "expired", "cancelled", "cancelling", "completed", "validating",
              "in_progress", "finalizing"]
    rows = [(s, t, s if t else "validating") for s in states for t in (0, 1)]
    df = spark.createDataFrame(rows, "id STRING, t INT, status STRING")
    got = {r.id: (r.status, r.outcome) for r in
           latest_status(df, "id", "status", ["t"]).collect()}
    want = ["failed"] * 5 + ["done"] + ["running"] * 3
    assert got == {s: (s, o) for s, o in zip(states, want, strict=True)}


def record(batch, status, total=0, completed=0, **times):
    return json.dumps({"id": batch, "status": status, "expires_at": 10**9, **times,
                       "request_counts": {"total": total, "completed": completed, "failed": 0}})


def test_status_stream_equals_table(spark, tmp_path):
    folder = tmp_path / "records"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join([
        record("x", "validating", created_at=1),
        record("y", "validating", created_at=2),
    ]))
    (folder / "2.json").write_text("\n".join([
        record("x", "completed", 8, 8, created_at=1, in_progress_at=3, completed_at=9),
        record("x", "in_progress", 8, 2, created_at=1, in_progress_at=3),
    ]))
    states, wanted = str(tmp_path / "states"), ["id", "status", "request_counts.completed", "outcome"]
    for checkpoint in ("c1", "c1", "c2"):  # once, again without news, and with a lost checkpoint
        query = start_status(spark, str(folder), states, str(tmp_path / checkpoint))
        assert query.awaitTermination(120)
    stream = {tuple(r) for r in read_states(spark, states).select(*wanted).collect()}
    table = spark.read.schema(BATCH_RECORD).json(str(folder))
    folded = {tuple(r) for r in fold_records(table).select(
        "id", "status", "request_counts.completed", "outcome").collect()}
    assert folded == {("x", "completed", 8, "done"), ("y", "validating", 0, "running")}
    assert folded == stream
    compact_states(spark, states, str(tmp_path / "small"), ended_before=10)
    assert [r.id for r in read_states(spark, str(tmp_path / "small")).collect()] == ["y"]


def test_records_of_one_second_follow_the_life_of_a_batch(spark, tmp_path):
    lines = [
        record("a", "finalizing", completed_at=5, finalizing_at=5), record("a", "completed", 1, 1, completed_at=5, finalizing_at=5),
        record("b", "failed", in_progress_at=7, failed_at=7), record("b", "in_progress", in_progress_at=7),
        record("c", "cancelling", cancelling_at=3), record("c", "cancelled", cancelling_at=3, cancelled_at=3),
    ]
    (tmp_path / "r.json").write_text("\n".join(lines))
    rows = fold_records(spark.read.schema(BATCH_RECORD).json(str(tmp_path))).collect()
    assert {r.id: (r.status, r.outcome) for r in rows} == {
        "a": ("completed", "done"), "b": ("failed", "failed"), "c": ("cancelled", "failed"),
    }


def test_file_record_schema(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"object":"file","id":"f","bytes":12,"status_details":null}')
    row = spark.read.schema(FILE_RECORD).json(str(tmp_path)).first()
    assert (row.id, row.bytes, row.status_details) == ("f", 12, None)
