"""Density clustering on radius or neighbour graphs: DBSCAN and single linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.components import connected_components
from kinweave.operators.neighbours import floor_graph, radius_counts, radius_links
from kinweave.sources.shared import materialize


def dbscan_edges(ids: DataFrame, edges: DataFrame, min_samples: int) -> DataFrame:
    """(id, comp, core) of every id over directed edges (id, nbr) that include self; comp is null for noise.

    A border row joins the lowest cluster among its core neighbours.
    """
    edges = materialize(edges.select("id", "nbr"), "density-edges")
    core = edges.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_samples).select("id")
    core = materialize(core, "core")
    inside = edges.join(core, "id", "left_semi").join(core.select(F.col("id").alias("nbr")), "nbr", "left_semi")
    return _placed(ids, core, inside, edges.join(core, "id", "left_anti"))


def _placed(ids: DataFrame, core: DataFrame, inside: DataFrame, outside: DataFrame) -> DataFrame:
    """Clusters of the core rows by the edges ``inside``, and of other rows by their edges (id, nbr) ``outside``."""
    loops = core.select("id", F.col("id").alias("nbr"))
    clusters = materialize(connected_components(inside.select("id", "nbr").unionByName(loops), "id", "nbr"), "core-clusters")
    border = (
        outside.join(clusters.select(F.col("id").alias("nbr"), "comp"), "nbr")
        .groupBy("id").agg(F.min("comp").alias("comp")).withColumn("core", F.lit(False))
    )
    placed = clusters.withColumn("core", F.lit(True)).unionByName(border)
    return ids.select("id").join(placed, "id", "left").select("id", "comp", F.coalesce("core", F.lit(False)).alias("core"))


def dbscan(df: DataFrame, eps: float, min_samples: int, id_col: str = "id", vec: str = "embedding", metric: str = "l2", **blocks) -> DataFrame:
    """(id, comp, core) over all vectors within ``eps`` of one another.

    Two passes over the distances, one for counts and one for links; only
    spanning forests and the few core neighbours of other rows are written.
    """
    core = materialize(radius_counts(df, eps, metric, id_col, vec, **blocks).filter(F.col("n") >= min_samples).select("id"), "core")
    links = materialize(radius_links(df, core, eps, metric, id_col, vec, **blocks), "density-links")
    return _placed(df.select(F.col(id_col).cast("long").alias("id")), core, links.filter("not border"), links.filter("border"))


def knn_dbscan(lists: DataFrame, eps: float, min_samples: int, least: float = 0.7) -> DataFrame:
    """DBSCAN on the neighbour graph with a similarity floor, links taken both ways, self counted."""
    kept = floor_graph(lists, least).filter(F.col("dist") <= eps)
    ids = lists.select("id").distinct()
    both = kept.select("id", "nbr").unionByName(kept.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"))).distinct()
    return dbscan_edges(ids, both.unionByName(ids.select("id", F.col("id").alias("nbr"))), min_samples)


def single_linkage(df: DataFrame, cut: float, id_col: str = "id", vec: str = "embedding", metric: str = "l2") -> DataFrame:
    """(id, comp): single-linkage clusters at distance ``cut``, which are the components of the graph d <= cut."""
    found = connected_components(radius_links(df, df.select(F.col(id_col).cast("long").alias("id")).distinct(), cut, metric, id_col, vec), "id", "nbr")
    return df.select(F.col(id_col).cast("long").alias("id")).join(found, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
