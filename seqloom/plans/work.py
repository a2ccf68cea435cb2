"""From the grid of work to stored results: probe what is pending, keep what was found, go on after a stop."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Row, functions as F

from seqloom.operators.joins import CELL
from seqloom.plans.probe import run_multi_seed
from seqloom.sources.readers import results_so_far, sink_results


def run_cell(data: DataFrame, cell: Mapping[str, str], seeds: Sequence[int], path: str, **options) -> str:
    """Probe one cell of the grid under the given seeds and store its keyed metric rows as one run."""
    rows = run_multi_seed(data, cell["task"], seeds, target=cell["target"], split_type=cell["split_type"], **options)
    return sink_results(rows.withColumns({name: F.lit(cell[name]) for name in CELL}), path)


def pending_cells(grid: DataFrame, path: str) -> list[Row]:
    """Cells of the grid with the seeds that have no stored result, in order. The grid is a list of work, not data."""
    done = results_so_far(grid.sparkSession, path).select(*CELL, "seed").distinct()
    missing = grid.join(done, [*CELL, "seed"], "left_anti")
    return missing.groupBy(*CELL).agg(F.array_sort(F.collect_set("seed")).alias("seeds")).orderBy(*CELL).collect()


def run_pending(grid: DataFrame, load: Callable[[Row], DataFrame], path: str, most: int | None = None, **options) -> int:
    """Run the pending cells, or the first `most` of them, and return how many were run.

    `load` gives a cell's table (`row_id`, features, target and what its splitter reads). A cell's seeds are stored together once
    all are done; a stop loses the cell in work and no other, and the next call takes up what is pending then.
    """
    cells = pending_cells(grid, path)[:most]
    for cell in cells:
        run_cell(load(cell), cell.asDict(), cell["seeds"], path, **options)
    return len(cells)
