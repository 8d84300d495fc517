"""Session helpers: cluster settings and the shared checkpoint folder."""

import pytest

from auric import session


def test_cluster_conf_sizes_partitions_from_cores():
    c = session.cluster_conf(8000)
    assert c["spark.sql.shuffle.partitions"] == "32000"
    assert c["spark.sql.adaptive.enabled"] == "true" and c["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert c["spark.sql.files.maxPartitionBytes"] == "256m"


def test_checkpoint_dir_reads_the_cluster_setting(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    got = session.checkpoint_dir(spark)
    if configured:
        assert got == configured
    assert spark.sparkContext.getCheckpointDir()


class _Conf:
    def get(self, key, default=None):
        return default


class _Ctx:
    def __init__(self, master="local[2]"):
        self.master, self.dirs = master, []

    def setCheckpointDir(self, d):
        self.dirs.append(d)

    def getCheckpointDir(self):
        return self.dirs[-1] if self.dirs else None


class _Session:
    def __init__(self, master="local[2]"):
        self.conf, self.sparkContext = _Conf(), _Ctx(master)


def test_checkpoint_dir_when_unset_registers_a_folder_without_setting_static_conf():
    s = _Session()
    d1 = session.checkpoint_dir(s)
    d2 = session.checkpoint_dir(s)
    assert d1 == d2 and s.sparkContext.dirs == [d1]


def test_a_cluster_must_name_the_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.checkpoint_dir(_Session(master))
