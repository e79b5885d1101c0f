"""Command line: compare all or the named queries; ``SF`` picks the data folder."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession

import __spark_entry__ as entry
from tests.compare import compare, duck

if __name__ == "__main__":
    sf_dir = os.environ.get("SF", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = [q for q in queries if not sys.argv[1:] or any(q.startswith(a) for a in sys.argv[1:])]
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            if name in oracles:
                diff = compare(spark, con, queries[name], oracles[name], sf_dir)
            else:
                n = queries[name](spark, sf_dir).count()
                diff = None if n else "no rows"
        except Exception as exc:
            diff = f"{type(exc).__name__}: {str(exc)[:1500]}"
        kind = "ok " if diff is None else "BAD"
        bad += diff is not None
        print(f"{kind} {name} {time.time() - start:.1f}s {'' if name in oracles else '(rows only)'} {diff or ''}", flush=True)
    print(f"{len(wanted)} queries, {bad} bad")
