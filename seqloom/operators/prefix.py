"""Prefix sums and cut points over orders too long for one task.

A window without a bounded partition runs in one task. The helpers here split the order into
parts, add up each part, and carry the sum of the earlier parts forward.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from seqloom.session import cut_lineage

PART_ROWS = 1 << 18  # rows of a range in a scan
OUT_ROWS = 1 << 14  # rows of an Arrow batch that a scan returns
HEX_DIGITS = 4  # 65,536 buckets: an edge bucket holds about a 65,536th of the rows


def shuffle_order(key: str | Column, seed: int | Column) -> Column:
    """A seeded pseudo-random order that every engine agrees on, total because the key is appended."""
    key = (F.col(key) if isinstance(key, str) else key).cast("string")
    seed = F.lit(seed).cast("string") if isinstance(seed, int) else seed.cast("string")
    return F.concat(F.md5(F.concat_ws(":", key, seed)), F.lit(":"), key)


def fill_cuts(
    items: DataFrame,
    order: str,
    weight: str,
    limit: Callable[[Column], Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """Last item taken when items are taken in `order` while the weight taken so far is below a limit.

    `order` starts with hexadecimal digits of a hash, so its first digits are evenly used. Weights are added
    up per prefix, the one prefix in which the limit falls is found from at most 65,536 sums, and
    only the items of that prefix are walked one by one. `limit` maps the total weight to the
    limit. Returns one row per `by` group with column `cut`; a group that takes nothing has no row.
    """
    by = list(by)
    coded = items.select(*by, order, weight, F.left(order, F.lit(HEX_DIGITS)).alias("_prefix"))
    sums = coded.groupBy(*by, "_prefix").agg(F.sum(weight).alias("_sum"))
    group = W.partitionBy(*by)
    earlier = group.orderBy("_prefix").rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("_sum").over(group)
    edge = sums.select(
        *by,
        "_prefix",
        "_sum",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
        F.least(limit(total), total).alias("_limit"),
    ).filter("_before < _limit AND _limit <= _before + _sum").drop("_sum")
    # One edge row per group (a seed, or everything), so the broadcast side is that small.
    inside = coded.join(F.broadcast(edge), [*by, "_prefix"])
    prior = F.sum(weight).over(
        W.partitionBy(*by, "_prefix").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        inside.withColumn("_prior", F.col("_before") + F.coalesce(prior, F.lit(0)))
        .filter("_prior < _limit")
        .groupBy(*by)
        .agg(F.max(order).alias("cut"))
    )


def up_to_cut(df: DataFrame, order: str | Column, cuts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """`df` with a boolean `filled`: whether the row's order is at or before its group's cut."""
    order = F.col(order) if isinstance(order, str) else order
    if not by:
        cut = cuts.agg(F.max("cut").alias("cut")).scalar()
        return df.withColumn("filled", F.coalesce(order <= cut, F.lit(False)))
    joined = df.join(F.broadcast(cuts), list(by), "left")
    return joined.withColumn("filled", F.coalesce(order <= F.col("cut"), F.lit(False))).drop("cut")


# ---- scans over rows in order ------------------------------------------------------------


def lay_out(df: DataFrame, order: str, by: Sequence[str] = (), parts: int | None = None) -> tuple[DataFrame, int]:
    """`df` in ranges of (`by`, `order`), sorted, written once, with the number of the range in `_part`; and how many ranges.

    There are as many ranges as hold `PART_ROWS` rows each, whatever the groups: a group with all the rows fills all ranges,
    and many small groups share one. Rows of one (`by`, `order`) should have been merged before.
    """
    df = cut_lineage(df)
    parts = parts or max(1, -(-df.count() // PART_ROWS))
    keys = [*by, order]
    if parts == 1:  # one sorted range comes out the same however often it is read
        return df.coalesce(1).sortWithinPartitions(*keys).withColumn("_part", F.lit(0)), 1
    return cut_lineage(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())), parts


def _whole(batches) -> pa.Table | None:
    held = [b for b in batches if len(b)]
    return pa.Table.from_batches(held) if held else None


def _group_starts(rows: pa.Table, by: Sequence[str]) -> np.ndarray:
    """Where a new group starts among sorted rows; nulls are a group, and so are values that are not numbers."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for name in by:
        column = rows.column(name).combine_chunks()
        a, b = column[:-1], column[1:]
        differ = np.asarray(pc.fill_null(pc.not_equal(a, b), False))
        if pa.types.is_floating(column.type):
            differ = differ & ~(np.asarray(pc.fill_null(pc.is_nan(a), False)) & np.asarray(pc.fill_null(pc.is_nan(b), False)))
        new[1:] |= differ | (np.asarray(a.is_null()) != np.asarray(b.is_null()))
    return np.flatnonzero(new)


def _same_group(a: tuple, b: tuple) -> bool:
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))


class _Carried:
    """What the neighbouring ranges hold of a range's first and last group: (before the first, after the last) per range."""

    def __init__(self, edges: list[tuple], merge: Callable, nothing):
        # edges: part, key of the first group, its values, key of the last group, its values, one group only
        self.before, self.after, self.nothing = {}, {}, nothing
        for step, into in ((1, self.before), (-1, self.after)):
            key, held = None, nothing
            for part, *ends, only in edges[::step]:
                (near, values), (far, far_values) = (ends[0:2], ends[2:4])[::step]
                reaches = key is not None and _same_group(key, near)
                into[part] = held if reaches else nothing
                key, held = far, (merge(into[part], values) if only else far_values)


def _edges(laid: DataFrame, parts: int, by: Sequence[str], values: Sequence[str], fold: Callable) -> list[tuple]:
    """A row per range: its first and its last group, and `fold` of their values. The only range has no neighbours."""
    if parts == 1:
        return []
    keys = [f for f in laid.schema.fields if f.name in by]
    key_type = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in keys) or "`_`: int"
    names = [f.name for f in keys]

    def summarise(batches):
        rows = _whole(batches)
        if rows is None:
            return
        starts = _group_starts(rows, names)
        columns = [np.asarray(rows.column(v)) for v in values]
        ends = np.append(starts[1:], len(rows))
        key = lambda i: {n: rows.column(n)[int(i)].as_py() for n in names} or {"_": 0}
        fold_of = lambda g: [fold(c[starts[g] : ends[g]]).item() for c in columns]
        yield pa.RecordBatch.from_pylist(
            [{"part": rows.column("_part")[0].as_py(), "first": key(0), "of_first": fold_of(0), "last": key(starts[-1]), "of_last": fold_of(-1), "only": len(starts) == 1}],
            schema=pa.schema([("part", pa.int32()), ("first", key_arrow), ("of_first", pa.list_(number)), ("last", key_arrow), ("of_last", pa.list_(number)), ("only", pa.bool_())]),
        )

    kind = "long" if all(laid.schema[v].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") for v in values) else "double"
    number = pa.int64() if kind == "long" else pa.float64()
    key_arrow = pa.struct([(f.name, to_arrow_type(f.dataType)) for f in keys]) if keys else pa.struct([("_", pa.int32())])
    schema = f"part int, first struct<{key_type}>, of_first array<{kind}>, last struct<{key_type}>, of_last array<{kind}>, only boolean"
    found = laid.select(*names, *values, "_part").mapInArrow(summarise, schema).orderBy("part").collect()  # a row per range
    return [(r["part"], tuple(r["first"]), tuple(r["of_first"]), tuple(r["last"]), tuple(r["of_last"]), r["only"]) for r in found]


def running_totals(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    parts: int | None = None,
    keep_parts: bool = False,
) -> DataFrame | tuple[DataFrame, int]:
    """Exclusive running sums and group totals along `order`, one row per (`by`, `order`) going in.

    Adds `<name>_before` and `<name>_total` per entry of `sums`. Two passes over ranges of rows: the first adds up the first and
    the last group of each range, the only ones that other ranges can share; the second adds running sums within the range
    to what the earlier ranges hold. No group is ever one task's work. With `keep_parts`, the rows keep `_part` and their order, and the number of
    ranges is returned too.
    """
    by, sums = list(by), list(sums)
    laid, parts = lay_out(df.withColumns({c: F.coalesce(c, F.lit(0).cast(df.schema[c].dataType)) for c in sums}), order, by, parts)
    carried = _Carried(_edges(laid, parts, by, sums, np.sum), lambda a, b: tuple(x + y for x, y in zip(a, b)), (0,) * len(sums))
    kinds = {c: "bigint" if laid.schema[c].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else "double" for c in sums}

    def scan(batches):
        rows = _whole(batches)
        if rows is None:
            return
        part = rows.column("_part")[0].as_py()
        earlier, later = carried.before.get(part, carried.nothing), carried.after.get(part, carried.nothing)
        starts = _group_starts(rows, by)
        lengths = np.diff(np.append(starts, len(rows)))
        out = list(rows.columns)
        for i, c in enumerate(sums):
            v = np.asarray(rows.column(c)).astype(np.int64 if kinds[c] == "bigint" else np.float64)
            total = np.add.reduceat(v, starts)
            base = np.zeros(len(starts), v.dtype)
            base[0] = earlier[i]
            total[0] += earlier[i]
            total[-1] += later[i]
            if kinds[c] == "bigint":
                run = np.cumsum(v) - v
                before = run - np.repeat(run[starts] - base, lengths)
            else:  # group by group, so that no group takes another one's rounding
                before = np.concatenate([b + np.cumsum(np.append(0.0, g[:-1])) for b, g in zip(base, np.split(v, starts[1:]))])
            out += [pa.array(before), pa.array(np.repeat(total, lengths))]
        yield from pa.table(out, names=names).to_batches(max_chunksize=OUT_ROWS)

    names = laid.columns + [f"{c}_{end}" for c in sums for end in ("before", "total")]
    added = ", ".join(f"`{c}_{end}` {kinds[c]}" for c in sums for end in ("before", "total"))
    totals = laid.mapInArrow(scan, T.StructType.fromDDL(f"{_ddl(laid)}, {added}"))
    return (totals, parts) if keep_parts else totals.drop("_part")


def least_from_here(laid: DataFrame, parts: int, value: str, output: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds the least `value` (double) of a row and all later rows of its group, over ranges laid out in order.

    As `running_totals`, in the other direction: a range needs the least value that later ranges hold of its last group.
    """
    by = list(by)
    carried = _Carried(_edges(laid, parts, by, [value], np.min), lambda a, b: (min(a[0], b[0]),), (float("inf"),))

    def scan(batches):
        rows = _whole(batches)
        if rows is None:
            return
        part = rows.column("_part")[0].as_py()
        v = np.asarray(rows.column(value)).astype(np.float64)
        v[-1] = min(v[-1], carried.after.get(part, carried.nothing)[0])
        groups = np.split(v, _group_starts(rows, by)[1:])
        least = np.concatenate([np.minimum.accumulate(g[::-1])[::-1] for g in groups])
        yield from pa.table([*rows.columns, pa.array(least)], names=[*rows.column_names, output]).to_batches(max_chunksize=OUT_ROWS)

    return laid.mapInArrow(scan, T.StructType.fromDDL(f"{_ddl(laid)}, `{output}` double"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
