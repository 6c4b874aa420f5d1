import json
import os

import numpy as np
import pytest

from kinweave.sources import files, shared


def test_round_trips(spark, tmp_path):
    x = np.arange(24, dtype="<f4").reshape(6, 4)
    x.tofile(tmp_path / "f.bin")
    df = files.read_features(spark, str(tmp_path / "f.bin"), 4)
    assert [(r.id, r.embedding) for r in df.orderBy("id").collect()] == [(i, v.tolist()) for i, v in enumerate(x)]
    assert files.read_features(spark, str(tmp_path / "f.bin"), 4, "m").columns == ["model", "id", "embedding"]
    with pytest.raises(Exception, match="no multiple"):
        files.read_features(spark, str(tmp_path / "f.bin"), 5).collect()
    files.write_features(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    labels = spark.createDataFrame([(2, -1), (0, 4), (1, 0)], "id long, label int")
    files.write_labels(labels, str(tmp_path / "meta"))
    assert sorted(map(tuple, files.read_labels(spark, str(tmp_path / "meta")).collect())) == [(0, 4), (1, 0), (2, -1)]
    (tmp_path / "list.txt").write_text("a\nb\nc\n")
    assert sorted(map(tuple, files.read_items(spark, str(tmp_path / "list.txt")).collect())) == [(0, "a"), (1, "b"), (2, "c")]
    index, classes, items = files.read_meta(spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "id long, label int"))
    assert {r.label: r.ids for r in index.collect()} == {1: [0, 1], 0: [2]} and (classes, items) == (2, 3)
    assert files.head(df, 2).count() == 2 and [r.id for r in files.first_rows(df, 2).collect()] == [0, 1]


def test_cache_and_json(spark, tmp_path):
    one = files.cached_table(spark.range(3), str(tmp_path), "key")
    assert files.cached_table(spark.range(9), str(tmp_path), "key").count() == one.count() == 3
    assert files.write_table(spark.range(4).selectExpr("id", "id % 2 AS p"), str(tmp_path / "p"), ["p"]).count() == 4
    path = str(tmp_path / "x.json")
    assert files.dump_json(spark, path, {"a": np.int64(3), "b": {2, 1}, "c": np.arange(2)})
    assert not files.dump_json(spark, path, {}) and json.load(open(path)) == {"a": 3, "b": [1, 2], "c": [0, 1]}
    assert files.dump_json(spark, path, {}, force=True) and json.load(open(path)) == {}


def test_materialized_tables_are_shared_and_released(spark):
    kept = shared.materialize(spark.range(5), "t")
    path = kept.inputFiles()[0]
    assert kept.count() == 5 and shared.shared_dir(spark) in path.replace("file:///", "file:///")
    assert shared.release(spark) >= 1 and not os.path.exists(path.removeprefix("file://"))
