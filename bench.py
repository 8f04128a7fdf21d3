"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

`value` sums the queries over the tables and the ten shapes over $BENCH_ROWS cached rows, as in earlier rounds. Beside
them: the shapes over the same rows as uncached Parquet, one shape over 10,000 to 50,000 rows, and on one core.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

from tabsieve.queries import QUERIES
from tabsieve.session import Engine
from tabsieve.sources import benchmark_table

#: The ten benchmark shapes over the generated table; the odd ones over the float columns.
SHAPES = [
    "uniform{t} > 60{z} and normal{t}5 < 0{z}",
    "uniform{t} > -60{z} and normal{t}5 < 5{z}",
    "(normal{t}20 + 40{z}) > (uniform{t} - 10{z})",
    "normal{t}5 * normal{t}20 >= -5{z} and normal{t}5 * normal{t}20 <= 5{z}",
    "uniform{t} >= -1{z} and uniform{t} <= 1{z} or normal{t}5 >= -1{z} and normal{t}5 <= 1{z} or normal{t}20 >= -1{z} and normal{t}20 <= 1{z}",
]


def timed(df, runs: int = 3) -> float:
    best = float("inf")
    for _ in range(runs):
        at = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - at)
    return round(best, 4)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shapes(engine: Engine, name: str, which: range = range(10)) -> dict[str, float]:
    """The benchmark shapes over the table `test`."""
    out = {}
    for n in which:
        t, z = (("i", ""), ("f", ".0"))[n % 2]
        shape = SHAPES[n // 2].format(t=t, z=z)
        columns = ", ".join(c for c in (f"uniform{t}", f"normal{t}5", f"normal{t}20") if c in shape)
        out[f"{name}_{n}"] = timed(engine.sql(f"select id, {columns} from test where {shape}"))
    return out


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)
    times = {}
    for name, query in QUERIES.items():
        if name.startswith("suite_") or name in ("scan_project", "filter_and", "math_fdiv", "num_rows"):
            times[name] = timed(query(spark, sf_dir))
    rows = int(os.environ.get("BENCH_ROWS", "8000000"))
    engine = Engine(spark, "reference").register_df("test", benchmark_table(spark, rows), "id")
    engine.preload("test")
    times |= shapes(engine, "cached")
    value, folder = sum(times.values()), tempfile.mkdtemp(prefix="tabsieve-bench-")
    try:
        engine.source("test").df.write.parquet(path := f"{folder}/test")
        engine.release("test")
        times |= shapes(Engine(spark, "reference").register_parquet("test", path, "id"), "parquet")
        for n in range(10_000, 50_001, 10_000):
            times[f"growth_{n}"] = shapes(Engine(spark, "reference").register_df("test", benchmark_table(spark, n), "id"), "x", range(1))["x_0"]
        spark.stop()
        spark = session("1")
        times |= shapes(Engine(spark, "reference").register_parquet("test", path, "id"), "parquet_one_core", range(0, 10, 4))
    finally:
        shutil.rmtree(folder)
    print(json.dumps({"metric": "sum of best-of-3 query seconds", "value": round(value, 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "rows_cached": rows}))
    spark.stop()


if __name__ == "__main__":
    main()
