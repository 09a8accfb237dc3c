"""Run registered queries and compare them with their expected results in DuckDB."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

import __spark_entry__
from paperweave.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def main(sf_dir: str, prefixes: list[str]) -> int:
    spark = local_session(8, "compare")
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    failed, oracle = [], __spark_entry__.oracle_sql()
    for name, query in __spark_entry__.queries().items():
        if prefixes and not name.startswith(tuple(prefixes)):
            continue
        start = time.perf_counter()
        df = query(spark, sf_dir)
        columns = sorted(df.columns)
        if name not in oracle:
            print(f"{name}: {df.count()} rows, no SQL, {time.perf_counter() - start:.1f} s", flush=True)
            continue
        got = Counter(tuple(r) for r in df.select(*columns).collect())
        took = time.perf_counter() - start
        wanted = Counter(db.execute(
            f"SELECT {', '.join(columns)} FROM ({oracle[name]})").fetchall())
        same = got == wanted
        print(f"{name}: {sum(got.values())} rows, {'equal' if same else 'DIFFERENT'}, {took:.1f} s",
              flush=True)
        if not same:
            failed.append(name)
            print("  only here:", list((got - wanted))[:2])
            print("  missing:  ", list((wanted - got))[:2])
    print("different:", failed or "none")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
