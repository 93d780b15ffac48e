from types import SimpleNamespace

import pytest

from tessella import session


def fake(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder or default)
    context = SimpleNamespace(getConf=lambda: conf, master=master, applicationId="app-1")
    return SimpleNamespace(sparkContext=context, conf=conf)


def test_scratch_folder_is_the_one_the_cluster_names():
    assert session.scratch_dir(fake("spark://h:7077", "hdfs:///scratch")) == "hdfs:///scratch/app-1"
    with pytest.raises(RuntimeError):
        session.scratch_dir(fake("spark://h:7077"))
    own = session.scratch_dir(fake("local[2]"))
    assert own.startswith("/tmp/spark-") and own == session.scratch_dir(fake("local[2]"))
