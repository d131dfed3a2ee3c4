"""Compare queries with their SQL counterparts, all values, any order."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and not math.isnan(value):
        return round(value, 6)
    return value


def compare(spark, con, query, sql: str, sf_dir: str) -> tuple[int, list[str]]:
    """Row count of the query and what differs."""
    frame = query(spark, sf_dir)
    columns = sorted(frame.columns)
    ours = Counter(tuple(_plain(r[c]) for c in columns) for r in frame.collect())
    relation = con.sql(sql)
    theirs_columns = sorted(relation.columns)
    if columns != theirs_columns:
        return sum(ours.values()), [f"columns {columns} against {theirs_columns}"]
    order = [relation.columns.index(c) for c in columns]
    theirs = Counter(tuple(_plain(r[i]) for i in order) for r in relation.fetchall())
    faults = []
    if ours != theirs:
        extra, missing = ours - theirs, theirs - ours
        faults.append(f"{sum(extra.values())} extra, e.g. {str(list(extra)[:2])[:900]}")
        faults.append(f"{sum(missing.values())} missing, e.g. {str(list(missing)[:2])[:900]}")
    return sum(ours.values()), faults


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as contract
    from listmill.session import local_session

    sf_dir, *wanted = sys.argv[1:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = contract.oracle_sql()
    for name, query in contract.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            n, faults = compare(spark, con, query, sqls[name], sf_dir) if name in sqls else (
                query(spark, sf_dir).count(), ["no SQL"])
        except Exception as e:  # report and go on with the next query
            n, faults = -1, [f"{type(e).__name__}: {str(e)[:1500]}"]
        print(f"{name:20s} {n:8d} rows {time.time() - start:6.2f}s {'ok' if not faults else ''}", flush=True)
        for fault in faults:
            print("    ", fault, flush=True)


if __name__ == "__main__":
    main()
