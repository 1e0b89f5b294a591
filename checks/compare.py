"""Run the queries and their SQL side by side: python -m checks.compare SF_DIR [name ...]."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double", "DATE": "date",
}


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("compare")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows), [columns[i] for i in order]


def main(sf: str, names: list[str]) -> int:
    spark, con, bad = session(), duckdb.connect(), 0
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf)
            mine = rows_of(df.columns, df.collect())
            mid = time.time()
            if name not in ORACLE:
                print(f"{name}: {len(mine[0])} rows, no SQL, {mid - start:.1f}s", flush=True)
                continue
            result = con.execute(ORACLE[name])
            theirs = rows_of([d[0] for d in result.description], result.fetchall())
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"{name}: ERROR {str(error)[:700]}", flush=True)
            continue
        same = mine == theirs
        kinds = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in result.description}
        odd = {n: (t, kinds.get(n)) for n, t in df.dtypes if kinds.get(n) != t}
        if odd:
            print("   types", name, odd, flush=True)
        bad += not same
        print(f"{name}: {'ok' if same else 'DIFFERENT'} {len(mine[0])}/{len(theirs[0])} rows, spark {mid - start:.1f}s, sql {time.time() - mid:.1f}s", flush=True)
        if not same:
            print("   columns", mine[1], theirs[1] if theirs[1] != mine[1] else "")
            left, right = sorted(set(mine[0]) - set(theirs[0])), sorted(set(theirs[0]) - set(mine[0]))
            print(f"   only spark {len(left)}, only sql {len(right)}")
            for a, b in list(zip(left, right))[:2]:
                at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), 0)
                at = max(0, at - 60)
                print("   spark", a[at : at + 300])
                print("   sql  ", b[at : at + 300])
            for a in left[:2] if not right else right[:2] if not left else []:
                print("   one side", a[:300])
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
