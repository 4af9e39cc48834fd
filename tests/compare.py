"""Run registered queries on Spark and their SQL on DuckDB and compare rows and schema.

    python -m tests.compare [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import time

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(cpus: str = "8") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("rankforge")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, np.integer)):
        return int(value)
    if isinstance(value, (float, np.floating)):
        return float(value) + 0.0
    return value if isinstance(value, str) else str(value)


def kind(name: str) -> str:
    name = name.lower()
    for group, words in {"int": ("bigint", "int", "integer", "smallint", "tinyint"),
                         "double": ("double",), "string": ("string", "varchar"),
                         "boolean": ("boolean",)}.items():
        if name in words:
            return group
    return "list" if name.endswith("[]") or name.startswith("array") else name


def compare(spark: SparkSession, con, fn, sql: str, folder: str) -> str:
    """Empty text when equal, else what differs."""
    df = fn(spark, folder)
    names = sorted(df.columns)
    types = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    cursor = con.execute(sql)
    oracle_names = [d[0] for d in cursor.description]
    oracle_types = {d[0]: kind(str(d[1])) for d in cursor.description}
    rows = cursor.fetchall()
    if sorted(oracle_names) != names:
        return f"columns {names} vs {sorted(oracle_names)}"
    if types != oracle_types:
        return f"types {[(n, types[n], oracle_types[n]) for n in names if types[n] != oracle_types[n]]}"
    pos = [oracle_names.index(n) for n in names]
    expected = [tuple(plain(r[i]) for i in pos) for r in rows]
    got = [tuple(plain(v) for v in r) for r in df.select(*names).collect()]
    if len(got) != len(expected):
        return f"rows {len(got)} vs {len(expected)}"
    order = lambda r: tuple((v is None, str(v)) for v in r)
    got.sort(key=order)
    expected.sort(key=order)
    bad = [(g, e) for g, e in zip(got, expected) if g != e]
    return "" if not bad else f"{len(bad)} of {len(got)} rows differ, first {names}: {bad[0]}"


def main() -> None:
    import __spark_entry__ as entry
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark, con = session(), duck(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args.names or any(n.startswith(a) for a in args.names)]
    failed = 0
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                text = compare(spark, con, queries[name], oracles[name], folder)
            else:
                rows = queries[name](spark, folder).toPandas()
                text = "" if isinstance(rows, pd.DataFrame) and len(rows) else "no rows"
        except Exception as error:  # noqa: BLE001
            text = f"{type(error).__name__}: {str(error)[:700]}"
        failed += bool(text)
        print(f"{'FAIL' if text else 'ok  '} {name:45s} {time.time() - start:6.2f}s "
              f"{'' if name in oracles else '(rows only) '}{text}", flush=True)
    print(f"{len(names) - failed} of {len(names)} passed")


if __name__ == "__main__":
    main()
