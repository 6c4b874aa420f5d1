"""Baseline clusterings of a data folder: ``python -m kinweave.plans.baselines DATA MODEL METHOD [name=value ...]``.

DATA holds features/MODEL.bin (float32 rows) and, for scores, meta.txt (one
class a line). Labels go to OUT/METHOD-name-value-.../meta as one label a line,
in order of id; labels found there are read instead, unless ``--force``.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from kinweave.operators import evaluate, labels
from kinweave.plans.cluster import baseline
from kinweave.plans.config import log, timed
from kinweave.sources import files


def result_path(out: str, method: str, options: dict) -> str:
    """Where the labels of a method with these options are kept."""
    return "/".join([out.rstrip("/"), "-".join([method, *(f"{k}-{v:g}" if isinstance(v, float) else f"{k}-{v}" for k, v in sorted(options.items()))]), "meta"])


def run_baseline(features: DataFrame, method: str, out: str, force: bool = False, truth: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame | None]:
    """((id, label) with dense labels in order of first appearance, pairwise scores against ``truth``).

    Items left out (-1) count as clusters of their own in the scores.
    """
    spark, path = features.sparkSession, result_path(out, method, options)
    if force or not files.exists(spark, f"{path}/_SUCCESS"):
        with timed(method):
            files.write_labels(labels.relabel(baseline(method, features, **options)), path)
    else:
        log.info("labels found: %s", path)
    found = files.read_labels(spark, path)
    log.info("%s", evaluate.summary(found).first())
    scores = None if truth is None else evaluate.pairwise_fscore(evaluate.paired(truth, labels.keep_singletons(found)))
    return found, scores


def _value(text: str) -> int | float | str:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("data")
    parser.add_argument("model")
    parser.add_argument("method")
    parser.add_argument("options", nargs="*", metavar="name=value")
    parser.add_argument("--dims", type=int, default=256)
    parser.add_argument("--out", default="baseline-output")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--evaluate", action="store_true")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    options = {k: _value(v) for k, v in (x.split("=", 1) for x in given.options)}
    truth = files.read_labels(spark, f"{given.data}/meta.txt") if given.evaluate else None
    found, scores = run_baseline(files.read_features(spark, f"{given.data}/features/{given.model}.bin", given.dims), given.method, given.out, given.force, truth, **options)
    report = {"method": given.method, "clusters": evaluate.cluster_count(found).first()[0]}
    if scores is not None:
        report.update(scores.select("prec", "recall", "fscore").first().asDict())
    print(json.dumps(report))


if __name__ == "__main__":
    main()
