"""Exact quantiles and ranks of groups of any size, by value blocks.

No task sees a group. Values are first counted, so that a value that a third of the rows share is one row with its
count. The distinct values, in the order of group and value, are dealt over partitions by range (approximate cuts), which a
distinct value can't make uneven, and written with their partition's number: a part of a group in a partition is a
value block. Sums per block give each block the number of the group's rows before it. From there on

* a quantile needs only the blocks that hold its two ranks: running counts are made inside these;
* a rank is the rows before the block and before the value, joined back to the rows. Values that more than a
  thousandth of all rows share are few by that definition and are broadcast; others meet their rows by a shuffle in which no
  key has more than that share.

Nulls are no values for quantiles; they rank first. NaN is the greatest value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantide.functions.shared import written

#: values with more than this share of all rows are joined back by broadcast; there are at most 1 / SHARE of them
SHARE = 0.001


def _same(left: DataFrame, right: DataFrame, names: dict[str, str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[r]) for k, r in names.items()])


def value_blocks(rows: DataFrame, keys: list[str], value: str = "value", name: str = "values", weight: str | None = None) -> DataFrame:
    """keys, value, n and _block: the distinct values of the groups with their counts, in blocks whose numbers follow their order. A row counts as many as ``weight`` says."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    return written(counted.repartitionByRange(parts, *keys, value).withColumn("_block", F.spark_partition_id()), name)


def block_offsets(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _block, _rows (its own), _before (the group's rows in blocks before) and _total: a row for each block."""
    group = Window.partitionBy(*keys)
    sums = blocks.groupBy(*keys, "_block").agg(F.sum("n").alias("_rows"))
    before = F.sum("_rows").over(group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    return sums.select(*keys, "_block", "_rows", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(group).alias("_total"))


def _with_offsets(blocks: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    names = {k: f"_o_{k}" for k in [*keys, "_block"]}
    offsets = offsets.withColumnsRenamed(names)
    return blocks.join(offsets, _same(blocks, offsets, names)).drop(*names.values())


def _upto(keys: list[str], value: str) -> Column:
    inside = Window.partitionBy(*keys, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0))


def quantiles(rows: DataFrame, keys: list[str], qs: list[float], value: str = "value", clipped: list[float] | None = None) -> DataFrame:
    """keys and q, an array of the quantiles (linear between neighbours) of the group's values; null values don't count, groups without any have no row.

    ``clipped`` are further quantiles, of the values after they are clipped to the first and the last of ``qs``: clipping keeps their order, so one pass has both.
    """
    return block_quantiles(value_blocks(rows.where(F.col(value).isNotNull()), keys, value, "quantiles"), keys, qs, value, clipped)


def block_quantiles(blocks: DataFrame, keys: list[str], qs: list[float], value: str = "value", clipped: list[float] | None = None) -> DataFrame:
    """What ``quantiles`` gives, from value blocks without nulls."""
    place = [F.lit(q) * (F.col("_total") - 1) for q in [*qs, *(clipped or [])]]
    wanted = F.array_distinct(F.concat(*[F.array(F.floor(p), F.ceil(p)) for p in place]))
    offsets = block_offsets(blocks, keys).withColumn("_ranks", F.filter(wanted, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_rows"))))
    near = _with_offsets(blocks, offsets.where(F.size("_ranks") > 0), keys).withColumn("_at", _upto(keys, value))
    found = near.withColumn("_ranks", F.filter("_ranks", lambda r: (r >= F.col("_at")) & (r < F.col("_at") + F.col("n")))).where(F.size("_ranks") > 0)
    # a handful of rows for each group
    picked = found.select(*keys, value, "_total", F.explode("_ranks").alias("_rank")).groupBy(*keys).agg(F.any_value("_total").alias("_total"), F.map_from_entries(F.collect_list(F.struct("_rank", value))).alias("_of"))
    pairs = [tuple(F.try_element_at("_of", f(p)) for f in (F.floor, F.ceil)) for p in place]
    first, last = (_between(*pairs[k], place[k]) for k in (0, len(qs) - 1))
    pairs = [*pairs[: len(qs)], *[tuple(F.least(F.greatest(v, first), last) for v in pair) for pair in pairs[len(qs) :]]]
    return picked.select(*keys, F.array(*[_between(a, b, p) for (a, b), p in zip(pairs, place, strict=True)]).alias("q"))


def _between(a: Column, b: Column, p: Column) -> Column:
    return F.when(a == b, a).otherwise(a * (F.ceil(p) - p) + b * (p - F.floor(p)))


def ranked_values(rows: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """keys, value, n (its rows), _at (rows of the group before it) and _total; nulls are a value, the first."""
    blocks = value_blocks(rows.select(*keys, value, *([weight] if weight else [])), keys, value, "ranks", weight)
    return _with_offsets(blocks, block_offsets(blocks, keys), keys).withColumn("_at", _upto(keys, value)).select(*keys, value, "n", "_at", "_total")


def average_ranks(rows: DataFrame, keys: list[str], value: str, counted: DataFrame | None = None) -> DataFrame:
    """The rows with _rank (from 1, equal values at their average) and _total, the group's rows. The rows are read three times: write them before.

    ``counted`` has keys, value (also null) and n, its rows, where they were counted already; then the rows are read twice.
    """
    values = written(ranked_values(rows, keys, value) if counted is None else ranked_values(counted, keys, value, "n"), "ranked")
    every = values.agg(F.sum("n")).first()[0] or 0
    names = {k: f"_v_{k}" for k in [*keys, value]}
    values = values.select(*[F.col(k).alias(r) for k, r in names.items()], "n", (F.col("_at") + (F.col("n") + 1) / 2).alias("_rank"), "_total")
    common = values.where(F.col("n") > SHARE * every)
    on = _same(rows, values, names)
    many = rows.join(F.broadcast(common), on)
    few = rows.join(F.broadcast(common), on, "left_anti").join(values.where(F.col("n") <= SHARE * every), on)
    return many.unionByName(few).drop(*names.values(), "n")
