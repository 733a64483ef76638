"""Runs queries beside their SQL: python tests/check_queries.py FOLDER [name ...]"""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

import __spark_entry__ as entry


def connect(folder):
    con = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def frame(columns, rows):
    df = pd.DataFrame(rows, columns=columns)[sorted(columns)]
    return df.sort_values(list(df.columns), ignore_index=True) if len(df) else df


KINDS = {
    "int": ("INTEGER",), "bigint": ("BIGINT",), "double": ("DOUBLE",), "string": ("VARCHAR",),
    "boolean": ("BOOLEAN",),
}


def type_differences(mine, result):
    theirs = dict(zip(result.columns, map(str, result.types)))
    wrong = [f"{c} {t}/{theirs.get(c)}" for c, t in mine.dtypes if theirs.get(c) not in KINDS[t]]
    return f"types {wrong}" if wrong else None


def differences(left, right):
    if list(left.columns) != list(right.columns):
        return f"columns {list(left.columns)} / {list(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    for c in left.columns:
        a, b = left[c], right[c]
        if a.dtype.kind == "f" or b.dtype.kind == "f":
            same = ((a.astype(float) - b.astype(float)).abs() < 1e-9) | (a.isna() & b.isna())
        else:
            same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            i = (~same).idxmax()
            return f"{c}: {(~same).sum()} differ, e.g. {left.loc[i].to_dict()} / {right.loc[i].to_dict()}"[:900]
    return None


def main(folder, names):
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(folder), entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            out = query(spark, folder)
            mine = frame(out.columns, [tuple(r) for r in out.collect()])
            took = time.time() - began
            if name not in sql:
                print(f"ok    {name} {took:.1f}s rows={len(mine)} (no SQL)", flush=True)
                continue
            result = con.sql(sql[name])
            wrong = type_differences(out, result)
            wrong = differences(mine, frame(result.columns, result.fetchall())) or wrong
            print(f"{'WRONG' if wrong else 'ok   '} {name} {took:.1f}s rows={len(mine)} {wrong or ''}", flush=True)
            bad += bool(wrong)
        except Exception as error:
            bad += 1
            print(f"ERROR {name} {str(error)[:700]}", flush=True)
            if not isinstance(error, duckdb.Error):
                traceback.print_exc(limit=-3)
    print(f"{bad} bad", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
