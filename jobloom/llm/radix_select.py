"""The k rows of largest value in each group, by radix selection over distributed histograms.

A pass counts each group's rows by the next digit of their values, and the digit in which the
k-th lies narrows what the next pass looks at: rows are never sorted, nor gathered by group. A first
pass by the values' logarithms leaves little more than k rows a group for the others. Where more rows than fit share the k-th value, their items' UTF-8 bytes are refined in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Values have at most so many bits, and a digit so many of them.
VALUE_BITS, DIGIT_BITS = 60, 15
#: Classes of values by logarithm for each doubling.
CLASSES = 256
#: Bytes of an item that the first pass over ties looks at; each further pass looks at twice as many more.
FIRST_BYTES = 8


def _narrowed(rows: DataFrame, keys: list[str], digit: Column, down: bool) -> DataFrame:
    """rows with need -> for each group (keys, prefix, need, n): the digit in which the need-th row lies, its place there, and rows with that digit."""
    counted = rows.groupBy(*keys, "need", digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"))
    order = F.col("digit").desc() if down else F.col("digit").asc()
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumn("before", before).filter((F.col("before") < F.col("need")) & (F.col("before") + F.col("n") >= F.col("need")))
    return placed.select(*keys, F.col("digit").alias("prefix"), (F.col("need") - F.col("before")).alias("need"), "n")


def kth_values(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, prefix, need, n) of the groups with more than k rows: the k-th largest value, how many rows of that value fit, and how many there are."""
    state = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k).select(*keys, F.lit(0).cast("bigint").alias("prefix"), F.lit(k).cast("bigint").alias("need"))
    for shift in range(VALUE_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        inside = rows.join(state.drop("n"), keys).filter(F.shiftright("value", shift + DIGIT_BITS) == F.col("prefix"))
        state = _narrowed(inside, keys, F.shiftright("value", shift), down=True)
    return state


def largest(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """rows that can be among the k largest of their group: all whose value's class isn't below that of the k-th.

    Classes needn't be exact, as they never fall while values rise.
    """
    kind = F.floor(F.log2(F.col("value") + 1.0) * CLASSES)
    counted = rows.groupBy(*keys, kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = counted.withColumn("before", before).filter(F.col("before") < k).groupBy(*keys).agg(F.min("kind").alias("least"))
    return rows.join(least, keys).filter(kind >= F.col("least")).drop("least")


def tie_bounds(ties: DataFrame, keys: list[str]) -> DataFrame:
    """ties (keys, item, need) -> (keys, last, bytes): of each group, the first so many bytes of the need items that come first are at most last."""
    state, done, seen, width = ties.select(*keys, "need").distinct().withColumn("prefix", F.lit(b"")), None, 0, FIRST_BYTES
    raw = F.col("item").cast("binary")
    while True:
        inside = ties.drop("need").join(state, keys).filter(F.substring(raw, 1, seen) == F.col("prefix"))
        seen += width
        width *= 2
        state = saved(_narrowed(inside, keys, F.substring(raw, 1, seen), down=False), "ties")
        settled = state.filter("n = need").select(*keys, F.col("prefix").alias("last"), F.lit(seen).alias("bytes"))
        done = settled if done is None else done.union(settled)
        state = state.filter("n > need").drop("n")
        if state.isEmpty():
            return done


def top_k(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """rows (keys, item, value) -> the k of each group with the largest value, with rank from 1.

    Ties go by the item's UTF-8 bytes, ascending; items are distinct within a group and not null,
    values are at least 0 and below 2 ** VALUE_BITS. Groups of at most k rows stay whole, and an
    empty table gives no rows. rows are read twice, and what can be among the k is written.
    """
    rows = saved(largest(rows, keys, k), "largest")
    bounds = saved(kth_values(rows, keys, k), "kth").withColumnsRenamed({"prefix": "least", "n": "n_ties"})
    at = rows.join(bounds, keys, "left")
    above = at.filter(F.col("least").isNull() | (F.col("value") > F.col("least")) | ((F.col("value") == F.col("least")) & (F.col("n_ties") == F.col("need"))))
    tied = at.filter((F.col("value") == F.col("least")) & (F.col("n_ties") > F.col("need"))).select(*keys, "item", "value", "need")
    chosen = above.select(*keys, "item", "value")
    last = tie_bounds(tied, keys)
    fits = tied.join(last, keys).filter(F.substring(F.col("item").cast("binary"), F.lit(1), F.col("bytes")) <= F.col("last"))
    chosen = chosen.union(fits.select(*keys, "item", "value"))
    # k rows a group at most are left to sort
    return chosen.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item")))
