"""Run registered queries beside their SQL and compare rows, column names and types."""

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def _table(arrow):
    arrow = arrow.select(sorted(arrow.column_names))
    types = [(f.name, str(f.type).replace("large_", "")) for f in arrow.schema]
    columns = [c.to_pylist() for c in arrow.columns]
    return types, sorted(tuple(map(_cell, r)) for r in zip(*columns, strict=True))


def compare(spark, con, make, sql, folder):
    """None if equal, else a short account of the difference."""
    found_types, found = _table(make(spark, folder).toArrow())
    want_types, want = _table(con.sql(sql).to_arrow_table())
    if found_types != want_types:
        return f"types {found_types} / {want_types}"
    if found != want:
        only = [r for r in found if r not in set(want)][:2], [r for r in want if r not in set(found)][:2]
        return f"{len(found)} / {len(want)} rows; only here {str(only[0])[:500]}; only there {str(only[1])[:500]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config(
        "spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config(
        "spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    folder, wanted = sys.argv[1], sys.argv[2:]
    con, sql = connect(folder), entry.oracle_sql()
    for name, make in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sql:
                result = compare(spark, con, make, sql[name], folder) or "same"
            else:
                result = f"no SQL, {make(spark, folder).count()} rows"
        except Exception as error:
            result = f"FAILED {str(error)[:700]}"
        print(f"{name:30s}{time.time() - start:7.1f} s  {result}", flush=True)
