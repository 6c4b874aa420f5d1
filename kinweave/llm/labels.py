"""A bounded sample of labelled documents, for fitting small models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.sources.shared import materialize

#: Bytes that a sample may have on the driver.
ALL_BYTES = 64 << 20
_SCALE = 1 << 20


def labelled_sample(
    docs: DataFrame, labels: DataFrame, columns: list[str], max_docs: int, max_bytes: int, doc_id: str = "doc_id", text: str = "text", all_bytes: int = ALL_BYTES,
) -> list[tuple[bytes, tuple[int, ...]]]:
    """At most ``max_docs`` labelled (text, labels) of at most ``max_bytes`` each and ``all_bytes`` together.

    Texts are taken in order of their hash, so the sample does not depend on
    partitions; copies of a text meet before they are collected and count once.
    Rows with a null text or label are left out; conflicting labels of one text
    give the larger.
    """
    n = len(columns)
    one = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("key")).agg(*[F.max(c).cast("int").alias(f"y{i}") for i, c in enumerate(columns)])
    total = one.count()
    keep = min(_SCALE, int(_SCALE * max_docs / max(total, 1)) + 1)
    texts = docs.select(F.col(f"`{doc_id}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("t")).filter(F.octet_length("t") <= max_bytes).withColumn("h", F.xxhash64("t"))
    texts = texts.filter(F.pmod("h", F.lit(_SCALE)) < keep)
    joined = texts.join(one, "key").filter(" and ".join(f"y{i} is not null" for i in range(n)))
    distinct = materialize(joined.groupBy("h").agg(F.any_value("t").alias("t"), *[F.max(f"y{i}").alias(f"y{i}") for i in range(n)]), "labelled-sample")
    sizes = distinct.select("h", F.octet_length("t").alias("size")).orderBy("h").limit(max_docs).collect()
    held, last = 0, None
    for row in sizes:
        held += row["size"]
        if held > all_bytes:
            break
        last = row.h
    if last is None:
        return []
    rows = sorted(distinct.filter(F.col("h") <= last).collect(), key=lambda r: r.h)
    return [(bytes(r.t), tuple(r[f"y{i}"] for i in range(n))) for r in rows]
