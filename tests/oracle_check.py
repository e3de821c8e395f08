"""Run queries beside their SQL: ``python tests/oracle_check.py [sf] [query ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings conversations".split()


def oracle_connection(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def compare(spark, connection, name: str, sf_dir: str) -> str | None:
    """``None`` if both sides agree, else what differs."""
    frame = contract.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    ours = Counter(tuple(_cell(v) for v in row) for row in frame.select(*[f"`{c}`" for c in columns]).collect())
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return None if ours else "no rows"
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}"
    at = [names.index(c) for c in columns]
    theirs = Counter(tuple(_cell(row[i]) for i in at) for row in result.fetchall())
    if ours == theirs:
        kinds = {c: t for c, t in frame.dtypes}
        odd = {c: t for c, t in kinds.items() if t not in ("bigint", "int", "boolean", "double", "string")}
        return f"types {odd}" if odd else (None if ours else "both empty")
    more, less = ours - theirs, theirs - ours
    return (
        f"{sum(ours.values())} rows against {sum(theirs.values())}; only here {sum(more.values())}: "
        f"{list(more)[:3]}; only there {sum(less.values())}: {list(less)[:3]}"
    )


def main() -> None:
    from cartwise.session import build_session

    args = sys.argv[1:]
    sf_dir = f"/root/testdata/sf{args[0] if args else '0.01'}"
    spark = build_session(
        "check",
        "local[8]",
        **{"spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(sf_dir)
    failed = 0
    for name in args[1:] or contract.queries():
        began = time.time()
        try:
            problem = compare(spark, connection, name, sf_dir)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{time.time() - began:6.1f}s {name}: {problem or 'ok'}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
