"""Runs registered queries beside their oracles: python tests/compare.py SF_DIR [NAME...]."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(plain(y) for y in x.values())
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir, query, sql):
    """None, or what differs."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    kinds = {c[0]: str(c[1]) for c in want.description}
    df = query(spark, sf_dir)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)}, wanted {sorted(names)}"
    if odd := [n for n, k in kinds.items() if "HUGEINT" in k or "DECIMAL" in k]:
        return f"type of {odd}"
    got, wanted = rows_of(df.columns, df.collect()), rows_of(names, want.fetchall())
    if got != wanted:
        a, b = [r for r in got if r not in set(wanted)][:3], [r for r in wanted if r not in set(got)][:3]
        return f"{len(got)} rows, wanted {len(wanted)}; only got {a}, only wanted {b}"
    return None if got else "no rows"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or [n for n in queries if n in oracles]:
        began = time.time()
        try:
            found = compare(session, sys.argv[1], queries[name], oracles[name])
        except Exception as e:  # noqa: BLE001
            found = str(e)[:600]
        print(f"{name}: {'ok' if found is None else 'DIFFERS ' + found} ({time.time() - began:.1f} s)", flush=True)
