import os
import subprocess
import sys
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__
from kinweave.plans import catalogue

SF = "/root/testdata/sf0.001"
CHECKED = [
    "knn_cosine", "knn_block_join", "knn_recall_floor", "vote_pairs", "feat_affinity", "feat_structure", "propagate_bounded", "propagate_max_iter_merge", "propagate_soft", "fscore_kept", "dbscan", "dbscan_block_join",
    "radius_components", "rank_order_clusters", "cluster_sizes", "config_run_cached", "baseline_driver", "relabelled", "embedding_covariance",
    "knn_descent_floor", "knn_kd_floor", "average_linkage", "hdbscan_tree_parts", "assigned_to_fixed_centres", "whiten_given_projection", "labels_round_trip",
]


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", CHECKED)
def test_queries_match_their_sql(spark, name):
    got = catalogue.queries()[name](spark, SF)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = connection.sql(catalogue.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", ["propagate_bounded", "cluster_labels", "cluster_vote_end_to_end", "estimator_fit", "config_run_cached"])
def test_clusters_that_outlast_the_thresholds_match_their_sql(spark, tmp_path, name):
    """Two tight groups of 60 stay above the size limit after the last threshold; the SQL merges them."""
    r = np.random.default_rng(4)
    x = np.repeat(r.normal(size=(2, 64)), 60, axis=0) + 0.2 * r.normal(size=(120, 64))
    spark.createDataFrame([(i, v, i // 60) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.queries()[name](spark, str(tmp_path))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = connection.sql(catalogue.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and max(Counter(c for _, c in want).values()) > catalogue.MAX_SZ


def test_word_bins_are_counted_in_the_row(spark):
    lists = [[3, 3, 255], [0], list(range(256)) * 2]
    found = spark.createDataFrame(list(enumerate(lists)), "id long, bins array<int>").mapInArrow(catalogue._counted, "id long, embedding array<double>").collect()
    assert {r.id: r.embedding for r in found} == {i: [float(own.count(b)) for b in range(256)] for i, own in enumerate(lists)}


def test_queries_take_whole_vectors_of_the_given_table(spark, monkeypatch):
    sizes = {}
    note = lambda name: lambda df, *a, **o: sizes.update({name: (df.count(), len(df.first().embedding))})
    monkeypatch.setattr(catalogue.centroids, "gaussian_mixture", note("gaussian_mixture"))
    monkeypatch.setattr(catalogue.exemplars, "affinity_propagation", note("affinity_propagation"))
    monkeypatch.setattr(catalogue.modes, "mean_shift", note("mean_shift"))
    for name in ("gaussian_mixture", "affinity_propagation", "mean_shift"):
        catalogue.queries()[name](spark, SF)
    assert sizes == dict.fromkeys(sizes, (500, 64)) and len(sizes) == 3


def test_anchor_counts(spark):
    assert __spark_entry__.entry(spark).filter("label <> -1").count() == 286
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_anchor_of_one_threshold(spark):
    found = catalogue.queries()["propagate_max_iter_merge"](spark, "/root/testdata/sf0.01").groupBy("comp").count()
    assert (found.count(), found.agg({"count": "max"}).first()[0]) == (119, 311)


def test_entry_works_without_the_corpus_operators(tmp_path):
    """The entry, as it is, beside a library from which the corpus operators are gone."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.symlink(f"{here}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    os.mkdir(tmp_path / "kinweave")
    for part in os.listdir(f"{here}/kinweave"):
        if part not in ("llm", "__pycache__"):
            os.symlink(f"{here}/kinweave/{part}", tmp_path / "kinweave" / part)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_cosine' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; print(len(q), len(e.oracle_sql()))"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {str(tmp_path)!r}); {code}"], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
