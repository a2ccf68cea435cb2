import os

import numpy as np
from pyspark.sql import functions as F

from seqloom.operators import joins as J
from seqloom.plans import work
from seqloom.sources import readers as R


def rows(model, seeds, value):
    return [("d", model, "reg_lin", "t", "default", s, split, m, value) for s in seeds for split in ("val", "test") for m in ("r", "mse")]


def stored(spark, path, **keys):
    return sorted(tuple(r) for r in R.scan_results(spark, path, **keys).collect())


def files(path):
    return {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(path) for n in names}


def test_runs_are_added_and_the_last_one_counts(spark, tmp_path):
    path = str(tmp_path / "results")
    assert R.results_so_far(spark, path).collect() == []
    R.sink_results(spark.createDataFrame(rows("a", (1, 2), 0.5) + rows("b", (1,), 0.1), R.RESULTS), path)
    before = files(path)
    R.sink_results(spark.createDataFrame(rows("a", (2,), 0.9)[:2], R.RESULTS), path)  # a rerun with fewer metrics
    assert before.items() <= files(path).items()
    assert stored(spark, path) == sorted(rows("a", (1,), 0.5) + rows("a", (2,), 0.9)[:2] + rows("b", (1,), 0.1))
    assert stored(spark, path, model="b") == sorted(rows("b", (1,), 0.1)) and R.scan_results(spark, path, [2]).count() == 2


def test_two_writers_and_one_that_fails(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "results")
    frames = [spark.createDataFrame(rows("m", (s,), float(s)), R.RESULTS) for s in range(6)]
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda f: R.sink_results(f, path), frames))
    assert stored(spark, path) == sorted(r for s in range(6) for r in rows("m", (s,), float(s)))
    # a run without a commit
    late = spark.createDataFrame(rows("m", (0,), 99.0), R.RESULTS)
    late.write.partitionBy(*R.RESULT_FOLDERS).parquet(f"{path}/runs/run=9{'0' * 19}-x")
    assert stored(spark, path)[0][-1] == 0.0


def test_work_goes_on_where_it_stopped(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = spark.createDataFrame([(i, [float(v)], float(3 * v + e)) for i, (v, e) in enumerate(rng.normal(size=(60, 2)))], "row_id long, embedding array<double>, target double")
    catalogue = spark.createDataFrame([("d", "reg_lin", "target", "default"), ("e", "reg_ridge", "target", "default")], "dataset string, task string, target string, split_type string")
    grid, path, loaded = J.work_grid(catalogue, ["m", "n"], (5, 6), canonical=True), str(tmp_path / "r"), []

    def load(cell):
        loaded.append((cell["dataset"], cell["model"]))
        if len(loaded) == 3:
            raise RuntimeError("stopped")
        return data

    try:
        work.run_pending(grid, load, path)
    except RuntimeError:
        pass
    assert R.scan_results(spark, path).select("model", "dataset", "seed").distinct().count() == 4
    R.sink_results(spark.createDataFrame([("e", "n", "reg_ridge", "target", "default", 5, "test", "r", 0.5)], R.RESULTS), path)
    assert [(c.dataset, c.model, c.seeds) for c in work.pending_cells(grid, path)] == [("e", "m", [5, 6]), ("e", "n", [6])]
    assert work.run_pending(grid, load, path) == 2 and work.run_pending(grid, load, path) == 0
    assert J.resume_pending(grid, R.scan_results(spark, path)).count() == 0
    found = R.scan_results(spark, path, dataset="d", model="m").where("metric = 'r' AND split = 'test'").agg(F.min("value")).first()[0]
    assert found > 0.5
