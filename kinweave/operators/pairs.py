"""Candidate pairs: selection by threshold and votes, features, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.vectors import cosine, doubles


def canonical(directed: DataFrame) -> DataFrame:
    """(a, b, score) with a < b, from (id, rank, nbr, score): the score of the first entry by (id, rank)."""
    return (
        directed.groupBy(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b"))
        .agg(F.min_by("score", F.struct("id", "rank")).alias("score"))
    )


def _near(base: DataFrame, th: float) -> DataFrame:
    return base.filter((1 - F.col("dist") > th) & (F.col("id") != F.col("nbr"))).select("id", "rank", "nbr", (1 - F.col("dist")).alias("score"))


def votes(base: DataFrame, committee: list[DataFrame], th: float) -> DataFrame:
    """(id, rank, nbr, score, votes): of how many members ``nbr`` is in the list of ``id``; above ``th`` only."""
    near = _near(base, th)
    if not committee:
        return near.withColumn("votes", F.lit(0).cast("long"))
    cast = committee[0].select("id", "nbr")
    for member in committee[1:]:
        cast = cast.unionByName(member.select("id", "nbr"))
    counted = cast.groupBy("id", "nbr").agg(F.count(F.lit(1)).alias("votes"))
    return near.join(counted, ["id", "nbr"], "left").select("id", "rank", "nbr", "score", F.coalesce("votes", F.lit(0)).cast("long").alias("votes"))


def vote_pairs(base: DataFrame, committee: list[DataFrame], accept: int, th: float) -> DataFrame:
    """Pairs of which a direction is above ``th`` and has ``accept`` votes; no committee, no votes needed."""
    if accept > len(committee):
        raise ValueError(f"accept {accept} exceeds the committee of {len(committee)}")
    passed = votes(base, committee, th)
    return canonical(passed.filter(F.col("votes") >= accept) if committee else passed)


def all_pairs(base: DataFrame) -> DataFrame:
    """(a, b): every neighbour pair once, without threshold."""
    return base.filter("id <> nbr").select(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b")).distinct()


def relationship(pairs: DataFrame, committee: dict[str, DataFrame]) -> DataFrame:
    """``pairs`` with rel_<m>: 1 if either end is in the other's list of member m."""
    out = pairs
    for name, lists in committee.items():
        linked = all_pairs(lists).withColumn(f"rel_{name}", F.lit(1.0))
        out = out.join(linked, ["a", "b"], "left").fillna(0.0, [f"rel_{name}"])
    return out


def _wide(tables: dict[str, DataFrame], value: str) -> DataFrame:
    """(k, m): of each id an array with its ``value`` in every table (null: none), by one shuffle of all tables."""
    long = None
    for i, table in enumerate(tables.values()):
        part = table.select("k", F.lit(i).alias("i"), value)
        long = part if long is None else long.unionByName(part)
    return long.groupBy("k").agg(F.array(*[F.first(F.when(F.col("i") == i, F.col(value)), ignorenulls=True) for i in range(len(tables))]).alias("m"))


def _both(pairs: DataFrame, wide: DataFrame, how: str) -> DataFrame:
    """``pairs`` with ma and mb, the arrays of both ends."""
    of = lambda end: wide.select(F.col("k").alias(end), F.col("m").alias(f"m{end}"))
    return pairs.join(of("a"), "a", how).join(of("b"), "b", how)


def affinity(pairs: DataFrame, models: dict[str, DataFrame], id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """``pairs`` with aff_<m>: cosine of the two vectors of every model, in order; both ends must be in all models."""
    wide = _wide({name: features.select(F.col(id_col).alias("k"), doubles(vec).alias("v")) for name, features in models.items()}, "v")
    wide = wide.filter(~F.exists("m", lambda x: x.isNull()))
    out = _both(pairs, wide, "inner")
    return out.select(*pairs.columns, *[cosine(F.col("ma")[i], F.col("mb")[i]).alias(f"aff_{name}") for i, name in enumerate(models)])


def intersection(x: Column, y: Column) -> Column:
    """Common members of two neighbour arrays, padding left out."""
    return F.size(F.array_except(F.array_intersect(x, y), F.array(F.lit(-1).cast("long"))))


def structure(pairs: DataFrame, models: dict[str, DataFrame]) -> DataFrame:
    """``pairs`` with str_<m>: size of the intersection of the two lists of every model."""
    wide = _wide({name: lists.groupBy(F.col("id").alias("k")).agg(F.collect_list("nbr").alias("v")) for name, lists in models.items()}, "v")
    out = _both(pairs, wide, "left")
    counts = [F.coalesce(intersection(F.col("ma")[i], F.col("mb")[i]), F.lit(0)).cast("int").alias(f"str_{name}") for i, name in enumerate(models)]
    return out.select(*pairs.columns, *counts)


def labelled(pairs: DataFrame, truth: DataFrame, id_col: str = "id", label: str = "label") -> DataFrame:
    """``pairs`` with label 1 if both ends are of one class."""
    t = truth.select(F.col(id_col).alias("k"), F.col(label).alias("l"))
    joined = pairs.join(t.select(F.col("k").alias("a"), F.col("l").alias("la")), "a").join(t.select(F.col("k").alias("b"), F.col("l").alias("lb")), "b")
    return joined.withColumn("label", (F.col("la") == F.col("lb")).cast("double")).drop("la", "lb")


def ground_truth(pairs: DataFrame) -> DataFrame:
    """The pairs whose label is 1, all with score 1."""
    return pairs.filter("label = 1 and a <> b").select("a", "b").distinct().withColumn("score", F.lit(1.0))


def pair_set(base: DataFrame, committee: dict[str, DataFrame], features: dict[str, DataFrame], base_name: str = "base", truth: DataFrame | None = None, inputs: tuple[str, ...] = ("relationship", "affinity", "structure"), id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """All pairs of the base with the chosen features, and labels where ``truth`` is given."""
    out = all_pairs(base)
    if "relationship" in inputs:
        out = relationship(out, committee)
    if "affinity" in inputs:
        out = affinity(out, features, id_col, vec)
    if "structure" in inputs:
        out = structure(out, {base_name: base, **committee})
    return out if truth is None else labelled(out, truth, id_col)


def feature_columns(base_name: str, committee: list[str], inputs: tuple[str, ...] = ("relationship", "affinity", "structure")) -> list[str]:
    """Names of the classifier's inputs in order: C, C + 1 and C + 1 of them."""
    every = [base_name, *committee]
    out = [f"rel_{m}" for m in committee] if "relationship" in inputs else []
    out += [f"aff_{m}" for m in every] if "affinity" in inputs else []
    return out + ([f"str_{m}" for m in every] if "structure" in inputs else [])
