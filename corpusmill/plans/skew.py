"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than 1 / HOT_SHARE of all rows (and HOT_ROWS at least): there are at most HOT_SHARE such keys.
HOT_SHARE, HOT_ROWS = 1000, 1000


def join_hot(left: DataFrame, right: DataFrame, on: str, n_left: int, how: str = "inner") -> DataFrame:
    """left join right on a key that is unique in right and may be hot in left; how is inner or left.

    The right rows of hot keys, at most HOT_SHARE by the bound above, are broadcast; all other rows are shuffled.
    left is read twice and should be a written table.
    """
    hot = left.groupBy(on).agg(F.count("*").alias("n_hot")).filter(F.col("n_hot") > max(HOT_ROWS, n_left // HOT_SHARE)).select(on)
    own = right.join(F.broadcast(hot), on, "left_semi")
    marked = left.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), on, "left")
    one = marked.filter("is_hot").drop("is_hot").join(F.broadcast(own), on, how)
    return one.unionByName(marked.filter("is_hot IS NULL").drop("is_hot").join(right, on, how))
