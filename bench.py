"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

from meshwright.operators import stored
from meshwright.operators.burn import burn_chunks, burn_segments
from meshwright.operators.dense import materialize_runs
from meshwright.operators.results import covered_area
from meshwright.plans import queries, synth
from meshwright.plans.grid import Grid

HEADLINE = ("points_count", "lines_burn", "poly_coverage_edges", "poly_approx_runs", "covered_area_by_id", "materialize_last", "extract_sum", "zonal_weighted_mean", "tile_index")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="spark-")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": folder}
    start = time.time()
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    noop(queries.QUERIES["points_count"](spark, sf_dir))  # starts the engine
    started = round(time.time() - start, 3)
    took = {}
    runs = {n: (lambda n=n: queries.QUERIES[n](spark, sf_dir)) for n in HEADLINE}
    for n in (1_000, 10_000, 100_000):  # the same triangles on ever finer grids: time follows perimeter and rows, not cells
        grid = Grid(0.0, 0.0, 60.0, 60.0, n, n)
        runs[f"approx_{n}"] = lambda g=grid: burn_segments(synth.triangles(spark, sf_dir), None, g, "approx").runs
        runs[f"coverage_{n}"] = lambda g=grid: covered_area(burn_segments(synth.triangles(spark, sf_dir), None, g, combine=False))
    fine = Grid(0.0, 0.0, 60.0, 60.0, 100_000, 100_000)
    few = lambda: burn_segments(synth.triangles(spark, sf_dir).where("id <= 100"), None, fine, combine=False)
    runs["materialize_runs_100000"] = lambda: materialize_runs(few(), fn="last", check=False, width=1 << 20)
    coasts = {}
    for n, (rings, vertices, across) in {"4m": (4, 1_000_000, 4), "10m": (218, 46_400, 20)}.items():  # written before, as the published figures begin with geometries in memory
        coasts[n] = f"{stored.scratch(spark)}-coasts"
        synth.coasts(spark, rings, vertices, across).write.parquet(coasts[n])
    world, wide = (0.0, 0.0, 300.0, 165.0), (0.0, 0.0, 60.0, 15.0)
    for n, bounds, ncol, nrow in (("4m", wide, 256, 128), ("10m", world, 256, 128), ("10m", world, 4096, 2048), ("10m", world, 131_072, 65_536)):
        grid = Grid(*bounds, ncol, nrow)
        runs[f"coast_{n}_approx_{ncol}"] = lambda p=coasts[n], g=grid: burn_chunks(spark.read.parquet(p), grid=g, mode="approx", spread=False).runs
        if ncol <= 4096:
            runs[f"coast_{n}_coverage_{ncol}"] = lambda p=coasts[n], g=grid: covered_area(burn_chunks(spark.read.parquet(p), grid=g, spread=False))
    for name, make in runs.items():
        began = time.time()
        noop(make())
        took[name] = round(time.time() - began, 3)
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "headline queries, wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "start_up": started, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
