"""Where intermediate data goes: the configured folder, a local one for a local master, else an error."""

from types import SimpleNamespace

import pytest

from plotyard import session


class _Context:
    def __init__(self, master, conf):
        self.master, self._conf, self._dir = master, conf, None

    def getCheckpointDir(self):
        return self._dir

    def getConf(self):
        return self._conf

    def setCheckpointDir(self, folder):
        self._dir = folder


def _session(master, conf):
    return SimpleNamespace(sparkContext=_Context(master, conf), conf=conf)


class _Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


def test_a_configured_folder_is_used():
    fake = _session("spark://host:7077", _Conf({"spark.checkpoint.dir": "hdfs://store/shared"}))
    assert session.checkpoint_dir(fake) == "hdfs://store/shared"


def test_a_cluster_without_a_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(_session("spark://host:7077", _Conf()))


def test_a_local_master_may_use_a_local_folder():
    assert session.checkpoint_dir(_session("local[2]", _Conf()))


def test_hand_over_and_removal(spark):
    df = session.hand_over(spark.range(5), "five")
    assert sorted(r.id for r in df.collect()) == [0, 1, 2, 3, 4]
    path = session.scratch_path(spark, "gone")
    spark.range(1).write.parquet(path)
    session.remove_path(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    with pytest.raises(ValueError):
        session.remove_path(spark, "/tmp/else")


def test_text_flags_are_dealt_into_small_tasks(spark, monkeypatch):
    from plotyard import session
    from plotyard.operators import prepare

    cores = spark.sparkContext.defaultParallelism
    df = spark.createDataFrame([(i, "شقه", "مسبح") for i in range(20)], "id long, title string, content string").coalesce(1)
    monkeypatch.setattr(session, "input_bytes", lambda _: cores * session.SPREAD_BYTES_PER_TASK)
    flagged = prepare.with_text_flags(df)
    tasks = cores * session.SPREAD_BYTES_PER_TASK // session.HEAVY_BYTES_PER_TASK
    assert flagged.rdd.getNumPartitions() == tasks
    assert flagged.count() == 20


def test_rows_of_unknown_size_are_dealt_by_their_partitions(spark):
    from plotyard.operators import prepare

    cores, heavy = spark.sparkContext.defaultParallelism, session.SPREAD_BYTES_PER_TASK // session.HEAVY_BYTES_PER_TASK
    rows = [(i, "شقه", "مسبح") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, title string, content string").coalesce(1)  # its statistics are the largest long
    leaf_splits = spark.createDataFrame(rows, "id long, title string, content string").rdd.getNumPartitions()
    assert session.input_bytes(df) == leaf_splits * session.SPREAD_BYTES_PER_TASK
    flagged = prepare.with_text_flags(df)
    assert flagged.rdd.getNumPartitions() == max(cores, leaf_splits * heavy)
    assert flagged.count() == 20
    assert session.input_bytes(prepare.category_dimension(spark)) < 1 << 20
    assert session.input_bytes(spark.range(10).unionByName(df.select("id"))) > session.SPREAD_BYTES_PER_TASK - 1
