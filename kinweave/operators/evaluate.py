"""Scores of a clustering against true classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired(truth: DataFrame, pred: DataFrame, id_col: str = "id", check: bool = False) -> DataFrame:
    """(id, label, pred) of the items in both; ``check`` demands that both hold the same ids once."""
    t = truth.select(F.col(id_col).alias("id"), "label")
    p = pred.select("id", F.col("label").alias("pred"))
    both = t.join(p, "id")
    if check:
        sizes = {t.count(), p.count(), both.count()}
        if len(sizes) > 1:
            raise ValueError(f"truth, prediction and their join differ in size: {sorted(sizes)}")
    return both


def contingency(both: DataFrame) -> DataFrame:
    """(label, pred, n): items of each class in each cluster."""
    return both.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))


def dense_contingency(both: DataFrame, eps: float = 0.0) -> DataFrame:
    """One row per class and one column per cluster, with ``eps`` added to every cell."""
    table = both.groupBy("label").pivot("pred").count().fillna(0)
    return table.select("label", *[(F.col(f"`{c}`") + eps).alias(c) for c in table.columns if c != "label"])


def pairwise_fscore(both: DataFrame) -> DataFrame:
    """(tk, pk, qk, prec, recall, fscore): pairs in common, in clusters, in classes; percentages, null for 0 / 0."""
    table = contingency(both)
    # squares per class and cluster from the table of counts, then three sums
    rows = table.select(F.lit("t").alias("kind"), F.col("n")).unionByName(table.groupBy("pred").agg(F.sum("n").alias("n")).select(F.lit("p").alias("kind"), "n"))
    rows = rows.unionByName(table.groupBy("label").agg(F.sum("n").alias("n")).select(F.lit("q").alias("kind"), "n"))

    def pairs(kind: str):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n") * F.col("n") - F.col("n"))), F.lit(0)).cast("long")

    sums = rows.agg(pairs("t").alias("tk"), pairs("p").alias("pk"), pairs("q").alias("qk"))
    p, r = 100.0 * F.col("tk") / F.nullif("pk", F.lit(0)), 100.0 * F.col("tk") / F.nullif("qk", F.lit(0))
    return sums.select("tk", "pk", "qk", p.alias("prec"), r.alias("recall"), (2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("fscore"))


def fscore_removed(both: DataFrame) -> DataFrame:
    """Pairwise scores without the items left out (-1)."""
    return pairwise_fscore(both.filter("pred <> -1"))


def pair_accuracy(labelled: DataFrame) -> DataFrame:
    """(pairs, accuracy): share of pairs within one class."""
    return labelled.agg(F.count(F.lit(1)).alias("pairs"), F.avg("label").alias("accuracy"))


def pair_metrics(scored: DataFrame, th: float) -> DataFrame:
    """Classifier metrics of (score, label): acc, abs_recall (predicted share), rel_recall, false_pos, false_neg."""
    yes, real = F.col("score") > th, F.col("label") == 1
    one = lambda c: F.sum(c.cast("long"))
    s = scored.agg(
        F.count(F.lit(1)).alias("n"), one(yes).alias("p"), one(real).alias("q"), one(yes == real).alias("right"),
        one(yes & ~real).alias("fp"), one(~yes & real).alias("fn"),
    )
    share = lambda a, b: F.col(a) / F.nullif(b, F.lit(0))
    return s.select(
        share("right", F.col("n")).alias("acc"), share("p", F.col("n")).alias("abs_recall"), share("p", F.col("q")).alias("rel_recall"),
        share("fp", F.col("p")).alias("false_pos"), share("fn", F.col("n") - F.col("p")).alias("false_neg"),
    )


def summary(labels: DataFrame) -> DataFrame:
    """(num_images, num_class, num_per_class, discard_ratio) of a label table."""
    s = labels.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("label") != -1, F.col("label"))).alias("c"), F.count_if(F.col("label") != -1).alias("valid"))
    return s.select(F.col("n").alias("num_images"), F.col("c").alias("num_class"), (F.col("valid") / F.nullif("c", F.lit(0))).alias("num_per_class"), (1 - F.col("valid") / F.nullif("n", F.lit(0))).alias("discard_ratio"))


def cluster_count(labels: DataFrame) -> DataFrame:
    """(num_clusters): clusters, with each item left out as one of its own."""
    return labels.agg((F.count_distinct(F.when(F.col("label") != -1, F.col("label"))) + F.count_if(F.col("label") == -1)).alias("num_clusters"))


def cluster_sizes(labels: DataFrame, clusters: int | None = None) -> DataFrame:
    """(label, n) of every label; with ``clusters``, of 0 .. clusters-1, absent ones with 0."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    if clusters is None:
        return sizes
    every = labels.sparkSession.range(clusters).select(F.col("id").cast("int").alias("label"))
    return every.join(sizes, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def precision_at(scored: DataFrame, k: int) -> DataFrame:
    """(precision): percentage of rows whose ``label`` is among the ``k`` largest of ``output`` (array by class)."""
    order = F.transform(F.sequence(F.lit(0), F.size("output") - 1), lambda i: F.struct((-F.get(F.col("output"), i)).alias("s"), i.alias("i")))
    top = F.slice(F.transform(F.array_sort(order), lambda x: x["i"]), 1, k)
    return scored.agg((100.0 * F.avg(F.array_contains(top, F.col("label").cast("int")).cast("double"))).alias("precision"))
