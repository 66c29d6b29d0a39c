"""Exponentially weighted means of whole histories by a segmented scan.

A row's mean is S / W with S = sum of x r^age and W = sum of r^age over its own and all earlier values.  A stretch of a series maps
what comes in as an affine function: it multiplies by r^(number of its values) and adds its own sums.  So each region's
series is cut into chunks of the calendar and blocks of `BLOCK` rows, whose running sums are windows of their own; the
blocks' maps are composed by a second scan over one row for each block, and what is carried in goes back to
the rows.  Only window functions are used, and a region of any length is spread over as many tasks as it has chunks.

Running sums of x r^-age stay in the range of doubles: a block's exponents end at `BLOCK`, those of the second scan begin
anew every time the weights have fallen by 150 powers of ten.  What lies two such groups back has a weight under 1e-80 of the
newest value's, far below the last bit of a double."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BLOCK = 128
DECADES = 150


def ewm_means(rows: DataFrame, names: list[str], spans: list[int], key: str = "region_id", chunk: str = "month", label: str = "{name}_ewm{span}") -> DataFrame:
    """`rows`(key, ts, names, ...) with an adjusted exponentially weighted mean for each name and span.

    Ages count values, not rows: a null leaves the mean as it was, and is null only before the first value.  `chunk` is a unit of
    `date_trunc`; it decides how long a task's piece of a series is, never the result.  (key, ts) has to be unique."""
    for s in spans:
        if s < 2:
            raise ValueError("a span is 2 at least: below, the newest value is all there is")
    own = "_" + max(rows.columns, key=len)
    c = lambda n: f"{own}_{n}"
    in_chunk, in_block = W.partitionBy(key, c("chunk")).orderBy("ts"), W.partitionBy(key, c("chunk"), c("block")).orderBy("ts")
    out = rows.withColumn(c("chunk"), F.date_trunc(chunk, "ts")).withColumn(c("row"), F.row_number().over(in_chunk))
    out = out.withColumn(c("block"), F.floor((F.col(c("row")) - 1) / BLOCK).cast("int"))
    out = out.withColumns({c(f"n{i}"): F.count(n).over(in_block) for i, n in enumerate(names)})
    pairs = [(i, n, s) for i, n in enumerate(names) for s in spans]
    sums = {}
    for i, n, s in pairs:
        up, value = _power(s, -F.col(c(f"n{i}"))), F.col(n).cast("double")
        down = _power(s, F.col(c(f"n{i}")))
        sums[c(f"S{i}_{s}")] = F.coalesce(F.sum(value * up).over(in_block) * down, F.lit(0.0))
        sums[c(f"W{i}_{s}")] = F.coalesce(F.sum(F.when(value.isNotNull(), up)).over(in_block) * down, F.lit(0.0))
    out = out.withColumns(sums)
    last = lambda x: F.max_by(c(x), c("row")).alias(x)
    blocks = out.groupBy(key, F.col(c("chunk")).alias("chunk"), F.col(c("block")).alias("block")).agg(*(F.max(c(f"n{i}")).alias(f"n{i}") for i in range(len(names))), *(last(f"{k}{i}_{s}") for i, _, s in pairs for k in "SW"))
    carried = _carried(blocks, key, [(i, s) for i, _, s in pairs])
    # one row for each chunk: the rows are where they are, and aren't dealt again by block
    arrays = carried.groupBy(key, "chunk").agg(F.array_sort(F.collect_list(F.struct("block", *(f"{k}{i}_{s}" for i, _, s in pairs for k in "SW")))).alias(c("in"))).withColumnRenamed("chunk", c("chunk"))
    out = out.join(arrays, [key, c("chunk")])
    before = F.get(c("in"), F.col(c("block")))
    means = {}
    for i, n, s in pairs:
        down = _power(s, F.col(c(f"n{i}")))
        total, weight = (F.col(c(f"{k}{i}_{s}")) + down * before[f"{k}{i}_{s}"] for k in "SW")
        means[label.format(name=n, span=s)] = F.when(weight > 0, total / weight)
    return out.select(*rows.columns, *(m.alias(n) for n, m in means.items()))


def _power(span: int, age: Column) -> Column:
    return F.pow(F.lit(1 - 2 / (span + 1)), age.cast("double"))


def _carried(blocks: DataFrame, key: str, pairs: list[tuple[int, int]]) -> DataFrame:
    """(key, chunk, block, S.., W..): what all earlier blocks of the series carry into each block."""
    series = W.partitionBy(key).orderBy("chunk", "block")
    out = blocks
    for i in sorted({i for i, _ in pairs}):
        out = out.withColumn(f"end{i}", F.sum(f"n{i}").over(series)).withColumn(f"begin{i}", F.col(f"end{i}") - F.col(f"n{i}"))
    for i, s in pairs:
        most = max(BLOCK + 1, int(DECADES / -math.log10(1 - 2 / (s + 1))))
        group, zero = f"g{i}_{s}", F.lit(0.0)
        out = out.withColumn(group, F.floor(F.col(f"begin{i}") / most))
        base = F.col(group) * most
        so_far = W.partitionBy(key, group).orderBy("chunk", "block").rowsBetween(W.unboundedPreceding, -1)
        earlier = series.rowsBetween(W.unboundedPreceding, -1)
        ends = F.lead(group).over(series) != F.col(group)
        for k in "SW":
            x = f"{k}{i}_{s}"
            out = out.withColumn("_in", F.coalesce(F.sum(F.col(x) * _power(s, base - F.col(f"end{i}"))).over(so_far) * _power(s, F.col(f"begin{i}") - base), zero))
            out = out.withColumn("_out", F.when(ends, F.struct((F.col(x) + F.col("_in") * _power(s, F.col(f"n{i}"))).alias("v"), F.col(f"end{i}").alias("at"))))
            out = out.withColumn("_last", F.last("_out", ignorenulls=True).over(earlier))
            out = out.withColumn(x, F.col("_in") + F.coalesce(F.col("_last.v") * _power(s, F.col(f"begin{i}") - F.col("_last.at")), zero))
    return out.select(key, "chunk", "block", *(f"{k}{i}_{s}" for i, s in pairs for k in "SW"))
