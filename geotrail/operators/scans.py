"""Scans along flights in blocks, and order statistics, without a task that holds a whole flight or group.

``numbered`` range-sorts all rows of all groups at once and gives each its place in its group: parts of the sort are
counted, and only the counts are put in order. With places known, a flight is cut into blocks of a fixed number of rows.
A scan is then three steps: each block scans its own rows; one row a block says what it hands on (its last value, its
sum); these rows are scanned along the flight, and what comes to a block is put to its rows. Neighbours that lie in
another block come to it as copies of a few border rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .sequence import FLIGHT, ORDER

#: Rows of a block: what a task of a scan holds at least, and by what its number of blocks is less than that of rows.
BLOCK = 1 << 16


def _same(a: Sequence[str], prefix: str) -> Column:
    out = F.lit(True)
    for c in a:
        out = out & F.col(c).eqNullSafe(F.col(prefix + c))
    return out


def numbered(rows: DataFrame, groups: Sequence[str], order: Sequence[str], place: str = "place", size: str = "size") -> DataFrame:
    """``rows`` with ``place`` (from 0) in their group by ``order`` (nulls first) and the group's ``size``.

    Rows equal in ``order`` are told apart by a running number, so even a group of one value is dealt to many tasks. The
    rows are written once in their order; then one row a part and group is ordered by a window.
    """
    tie, part, at = "__tie", "__part", "__at"
    by = [F.col(c).asc_nulls_first() for c in [*groups, *order, tie]]
    dealt = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop(tie)
    table = written(dealt.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33)))
    counts = table.groupBy(*groups, part).agg(F.count("*").alias("__n"), F.min(at).alias("__first"))
    w = Window.partitionBy(*groups)
    counts = counts.withColumn("__before", F.sum("__n").over(w.orderBy(part)) - F.col("__n")).withColumn(size, F.sum("__n").over(w))
    counts = counts.select(*[F.col(c).alias(f"__g_{c}") for c in groups], F.col(part).alias("__in"), "__first", "__before", size)
    both = table.join(counts, (F.col(part) == F.col("__in")) & _same(groups, "__g_"))
    return both.select(*rows.columns, (F.col(at) - F.col("__first") + F.col("__before")).alias(place), size)


def in_blocks(rows: DataFrame, block_rows: int = BLOCK, order: Sequence[str] = ORDER) -> DataFrame:
    """``rows`` with ``place`` in their flight and the number ``block`` of the block of ``block_rows`` that holds it."""
    return numbered(rows, [FLIGHT], order).drop("size").withColumn("block", F.floor(F.col("place") / block_rows).cast("long"))


def _inside():
    return Window.partitionBy(FLIGHT, "block").orderBy("place")


def _carried(rows: DataFrame, handed: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """``rows`` with ``carry``, window columns over one row a block that holds ``handed``."""
    blocks = rows.groupBy(FLIGHT, "block").agg(*[c.alias(n) for n, c in handed.items()])
    blocks = blocks.select(F.col(FLIGHT).alias("__f"), F.col("block").alias("__b"), *[c.alias(n) for n, c in carry.items()])
    return rows.join(blocks, F.col(FLIGHT).eqNullSafe(F.col("__f")) & (F.col("block") == F.col("__b"))).drop("__f", "__b")


def _over(ahead: bool = False):
    w = Window.partitionBy(FLIGHT).orderBy("block")
    return w.rowsBetween(1, Window.unboundedFollowing) if ahead else w.rowsBetween(Window.unboundedPreceding, -1)


def fill_forward(blocked: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """Each of ``columns`` (or a copy named with ``suffix``) with the last value so far where it is null."""
    present = lambda c: F.when(F.col(c).isNotNull(), F.col("place"))
    handed = {f"__h_{c}": F.max_by(c, present(c)) for c in columns}
    out = _carried(blocked, handed, {f"__c_{c}": F.last(f"__h_{c}", ignorenulls=True).over(_over()) for c in columns})
    w = _inside().rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({c + suffix: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"__c_{c}")) for c in columns}).drop(*[f"__c_{c}" for c in columns])


def fill_backward(blocked: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """The same with the next value."""
    present = lambda c: F.when(F.col(c).isNotNull(), F.col("place"))
    handed = {f"__h_{c}": F.min_by(c, present(c)) for c in columns}
    out = _carried(blocked, handed, {f"__c_{c}": F.first(f"__h_{c}", ignorenulls=True).over(_over(True)) for c in columns})
    w = _inside().rowsBetween(0, Window.unboundedFollowing)
    return out.withColumns({c + suffix: F.coalesce(F.first(c, ignorenulls=True).over(w), F.col(f"__c_{c}")) for c in columns}).drop(*[f"__c_{c}" for c in columns])


def running_sum(blocked: DataFrame, columns: Sequence[str], suffix: str = "_sum") -> DataFrame:
    """Sums of each of ``columns`` from the flight's beginning; nulls add nothing."""
    handed = {f"__h_{c}": F.coalesce(F.sum(c), F.lit(0)) for c in columns}
    out = _carried(blocked, handed, {f"__c_{c}": F.sum(f"__h_{c}").over(_over()) for c in columns})
    w = _inside().rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({c + suffix: F.coalesce(F.sum(c).over(w), F.lit(0)) + F.coalesce(F.col(f"__c_{c}"), F.lit(0)) for c in columns}).drop(*[f"__c_{c}" for c in columns])


def with_neighbours(blocked: DataFrame, back: int, ahead: int, block_rows: int) -> DataFrame:
    """``blocked`` with copies of the rows within ``back`` before and ``ahead`` after each block; ``own`` marks the block's rows.

    A window that reaches no farther, over (dataset_id, block), sees what it would see along the whole flight. Of a block
    its size, ``back`` and ``ahead`` rows are held. Drop the copies with ``own`` after the window.
    """
    p = F.col("place")
    first, last = F.greatest(F.lit(0), F.floor((p - ahead) / block_rows)), F.floor((p + back) / block_rows)
    copies = blocked.withColumn("__b", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return copies.withColumn("own", F.col("__b") == F.col("block")).withColumn("block", F.col("__b")).drop("__b")


def neighbour(column: str, offset: int) -> Column:
    """The value ``offset`` rows on, over ``with_neighbours``; null beyond the flight's ends."""
    return F.lead(column, offset).over(_inside()) if offset >= 0 else F.lag(column, -offset).over(_inside())


# --- order statistics


def order_statistics(rows: DataFrame, groups: Sequence[str], x: str, shares: Sequence[float]) -> DataFrame:
    """One row a group: ``n``, and for the share at index i ``lo_i``, ``hi_i`` and ``at_i`` (index statistic).

    Of the non-null values in order, ``lo_i`` and ``hi_i`` stand at the floor and the ceiling of ``share * (n - 1)``, and
    ``at_i`` at ``int(share * n)``. The values are range-sorted over all tasks; only rows at the wanted places go on.
    """
    v = numbered(rows.where(F.col(x).isNotNull()).select(*groups, F.col(x).alias("__x")), groups, ["__x"], "__p", "__n")
    p, n = F.col("__p"), F.col("__n")
    places = {}
    for i, s in enumerate(shares):
        rank = F.lit(float(s)) * (n - 1)
        places |= {f"lo_{i}": F.floor(rank), f"hi_{i}": F.ceil(rank), f"at_{i}": F.least(n - 1, F.floor(F.lit(float(s)) * n))}
    hit = F.lit(False)
    for c in places.values():
        hit = hit | (p == c)
    return v.where(hit).groupBy(*groups).agg(F.max("__n").alias("n"), *[F.max(F.when(p == c, F.col("__x"))).alias(name) for name, c in places.items()])


def linear_of(i: int, share: float) -> Column:
    """The linearly interpolated quantile from the columns of ``order_statistics``."""
    rank = F.lit(float(share)) * (F.col("n") - 1)
    return F.col(f"lo_{i}") + (F.col(f"hi_{i}") - F.col(f"lo_{i}")) * (rank - F.floor(rank))
