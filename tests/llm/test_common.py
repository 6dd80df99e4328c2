import os

import pytest

from querywright.llm import common


def test_sweep_deletes_what_was_stored(spark):
    common.sweep(spark)
    df = common.stored(spark.range(5), "test")
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder) and df.count() == 5
    assert common.sweep(spark) == 1 and not os.path.exists(folder) and common.sweep(spark) == 0


def test_keys_are_broadcast_by_their_size(spark, monkeypatch):
    keys = common.stored(spark.range(50).selectExpr("concat('a long key ', id) AS k"), "keys")
    rows = spark.range(50).selectExpr("concat('a long key ', id) AS k")
    plan = lambda: rows.join(common.sized(keys), "k", "left_semi")._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 100)
    assert "broadcast" not in plan()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 10_000)
    assert "broadcast" in plan()


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
