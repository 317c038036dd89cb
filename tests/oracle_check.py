"""Compare registered queries with their reference SQL: ``python tests/oracle_check.py sf_dir [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

LAST: dict[str, int] = {}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def arrow_of(df):
    names = sorted(df.columns)
    return df.select(*[f"`{n}`" for n in names]).toArrow()


def compare(spark, connection, sf_dir: str, name: str) -> str | None:
    """None when equal, else what differs."""
    import __spark_entry__ as entry

    mine = arrow_of(entry.queries()[name](spark, sf_dir))
    result = connection.sql(entry.oracle_sql()[name]).to_arrow_table()
    theirs = result.select(sorted(result.column_names))
    if mine.column_names != theirs.column_names:
        return f"columns {mine.column_names} / {theirs.column_names}"
    types = [(n, str(a), str(b)) for n, a, b in zip(mine.column_names, mine.schema.types, theirs.schema.types) if not same_type(a, b)]
    if types:
        return f"types {types}"
    LAST["rows"] = mine.num_rows
    left, right = (sorted(map(repr, rows(t))) for t in (mine, theirs))
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    if left != right:
        extra, lacking = [x for x in left if x not in set(right)][:3], [x for x in right if x not in set(left)][:3]
        return f"values: only Spark {extra}, only SQL {lacking}"
    return None


def same_type(a, b) -> bool:
    a, b = str(a).replace("large_", ""), str(b).replace("large_", "")
    return a == b or {a, b} <= {"string", "null"} or (a.startswith("timestamp") and b.startswith("timestamp"))


def rows(table):
    return zip(*[c.to_pylist() for c in table.columns]) if table.num_columns else []


def main() -> int:
    import __spark_entry__ as entry
    from clinicframe.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    connection, bad = connect(sf_dir), 0
    for name in wanted or entry.queries():
        start = time.time()
        try:
            problem = compare(spark, connection, sf_dir, name) if name in entry.oracle_sql() else "no SQL"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name}: {problem or f'ok, {LAST.get("rows")} rows'} ({time.time() - start:.1f}s)", flush=True)
    print(f"{bad} of {len(wanted or entry.queries())} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
