"""Approximate rank-order clustering over neighbour lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.components import connected_components

NOT_MUTUAL = 9999.0


def rank_order_distance(lists: DataFrame) -> DataFrame:
    """(id, nbr, d) of every list entry behind the first, which is the vector itself.

    With Oi the 0-based place of nbr for id and Oj the 1-based place of id for
    nbr: (|fi[:Oi] minus fj| + |fj[:Oj] minus fi|) / min(Oi, Oj); 9999 unless mutual.
    """
    nbrs = F.transform(F.array_sort(F.collect_list(F.struct("rank", "nbr"))), lambda x: x["nbr"])
    w = lists.groupBy("id").agg(nbrs.alias("f"))
    entries = w.select("id", F.col("f").alias("fi"), F.posexplode("f").alias("oi", "nbr")).filter("oi > 0")
    both = entries.join(w.select(F.col("id").alias("nbr"), F.col("f").alias("fj")), "nbr")
    oj = F.array_position("fj", F.col("id"))
    apart = F.size(F.array_except(F.slice("fi", F.lit(1), F.col("oi")), F.col("fj"))) + F.size(F.array_except(F.slice("fj", F.lit(1), oj), F.col("fi")))
    return both.select("id", "nbr", F.when(oj == 0, NOT_MUTUAL).otherwise(apart / F.least(F.col("oi"), oj)).alias("d"))


def rank_order_clusters(lists: DataFrame, th: float = 2.0) -> DataFrame:
    """(id, comp): components of entries with distance at most ``th``, links taken both ways."""
    near = rank_order_distance(lists).filter(F.col("d") <= th)
    found = connected_components(near, "id", "nbr")
    ids = lists.select("id").distinct()
    return ids.join(found, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
