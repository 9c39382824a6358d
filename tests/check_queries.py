"""Compare registered queries with their SQL in DuckDB.

    python tests/check_queries.py SF_DIR [name ...]
"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from proxyspark.fixtures import TABLES  # noqa: E402


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6g}" if v else "0"
    return str(v)


def kind(dtype):
    d = str(dtype).lower()
    for name, words in {"int": ("int", "long"), "float": ("double", "float"), "bool": ("bool",), "text": ("string", "varchar")}.items():
        if any(w in d for w in words):
            return name
    return d


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def compare(spark, con, name, sf_dir):
    df = contract.queries()[name](spark, sf_dir)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return "no-sql" if ours else "EMPTY", len(ours), 0, ""
    rel = con.sql(sql)
    theirs = rows(rel.columns, rel.fetchall())
    types = {c: kind(t) for c, t in zip(rel.columns, rel.types)}
    mine = {c: kind(t) for c, t in df.dtypes}
    note = ""
    if mine != types:
        note = f"types {sorted(set(mine.items()) ^ set(types.items()))}"
    if ours != theirs:
        left, right = set(ours), set(theirs)
        extra = sorted(left - right)[:2], sorted(right - left)[:2]
        return "DIFF", len(ours), len(theirs), f"{note} {extra}"
    return ("ok" if not note else "TYPES"), len(ours), len(theirs), note


def main():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(contract.queries())
    con, bad = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            state, n, m, note = compare(spark, con, name, sf_dir)
        except Exception as err:  # report and go on
            state, n, m, note = "ERROR", 0, 0, f"{type(err).__name__}: {str(err)[:600]}"
        bad += state not in ("ok", "no-sql")
        print(f"{state:7} {name:28} {n:7} {m:7} {time.time() - start:6.2f}s {note}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
