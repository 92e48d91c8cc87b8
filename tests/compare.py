"""Run queries and their SQL side by side: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(names, rows):
    """Rows with the columns in name order, sorted."""
    order = sorted(range(len(names)), key=lambda at: names[at])
    return sorted(tuple(row[at] for at in order) for row in map(list, rows)) if all(
        value is not None for row in rows for value in row
    ) else sorted((tuple(row[at] for at in order) for row in map(list, rows)), key=repr)


def differences(spark, con, query, sql, sf_dir):
    """None when both sides have the same columns and rows, else what differs."""
    start = time.time()
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    print(f"    spark {time.time() - start:.1f}s", flush=True)
    result = con.execute(sql)
    columns = [column[0] for column in result.description]
    theirs = rows_of(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if ours != theirs:
        left, right = set(ours) - set(theirs), set(theirs) - set(ours)
        return (
            f"{len(ours)} and {len(theirs)} rows; only ours {len(left)}: {sorted(left, key=repr)[:3]}; "
            f"only theirs {len(right)}: {sorted(right, key=repr)[:3]}"
        )
    kinds = {name: kind for name, kind in df.dtypes}
    print(f"    {len(ours)} rows {kinds}", flush=True)
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry

    from wordloom.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(sf_dir), []
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            problem = differences(spark, con, query, entry.oracle_sql()[name], sf_dir)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{name}: {'ok' if problem is None else problem} {time.time() - start:.1f}s", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
