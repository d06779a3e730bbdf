"""Compare registered queries with their oracles: python tests/oracle_compare.py SF_DIR [NAME...]"""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def same(x, y):
    """Floats are equal to nine digits: a mean of money can end in exactly half of the last place, and is summed in other orders."""
    if isinstance(x, float) and isinstance(y, float):
        return x == y or abs(x - y) <= 1e-9 * max(abs(x), abs(y))
    return x == y


def difference(spark, con, query, sql, sf_dir):
    """None, or what differs between the query's and the oracle's rows."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    bad = [(a, b) for a, b in zip(mine, theirs) if not all(map(same, a, b))]
    if bad:
        columns = sorted({n for a, b in bad[:200] for n, x, y in zip(sorted(names), a, b) if not same(x, y)})
        a, b = bad[0]
        return f"{len(bad)} of {len(mine)} rows differ, in {columns}; first: {[(n, x, y) for n, x, y in zip(sorted(names), a, b) if not same(x, y)]}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    queries, oracles, con = entry.queries(), entry.oracle_sql(), connect(sys.argv[1])
    for name in sys.argv[2:] or [n for n in queries if n in oracles]:
        t = time.time()
        try:
            found = difference(spark, con, queries[name], oracles[name], sys.argv[1])
        except Exception as e:  # noqa: BLE001
            found = f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{name}: {'ok' if found is None else found} ({time.time() - t:.1f} s)", flush=True)
