from types import SimpleNamespace

import pytest

from noteweave.session import shared_folder


def _spark(master, conf=None, kept=True):
    made = []
    sc = SimpleNamespace(
        master=master, getConf=lambda: SimpleNamespace(get=lambda k: conf), _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: kept))), setCheckpointDir=made.append
    )
    return SimpleNamespace(sparkContext=sc), made


def test_a_cluster_needs_a_shared_folder():
    """A machine-local folder is set only where the executors are this very process."""
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            shared_folder(_spark(master)[0])
        spark, made = _spark(master, conf="hdfs:///shared")
        shared_folder(spark)
        assert not made
    spark, made = _spark("local[4]")
    shared_folder(spark)
    assert len(made) == 1
