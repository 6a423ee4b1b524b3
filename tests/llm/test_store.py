"""The shared folder: never a machine-local one on a cluster; scratch tables go when they are done with."""

import glob
from types import SimpleNamespace

import pytest

from calorgrid.llm import store


def session(master, named=None):
    conf = SimpleNamespace(get=lambda k, d=None: named or d)
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda p: None)
    return SimpleNamespace(conf=conf, sparkContext=context)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[2,1,1024]"])
def test_no_local_folder_on_a_cluster(master):
    with pytest.raises(RuntimeError):
        store.shared_dir(session(master))
    assert store.shared_dir(session(master, "hdfs://x/y/")) == "hdfs://x/y"


def test_local_master_gets_a_folder():
    assert store.shared_dir(session("local[4]")).startswith("file:///")


def test_scratch_is_deleted(spark):
    with store.Scratch(spark, "scratch-test") as s:
        at = s.path.removeprefix("file:")
        a = s.cut(spark.range(5), "a")
        b = s.cut(a.selectExpr("id + 1 AS id"), "b")
        assert len(glob.glob(f"{at}/*")) == 2
        s.drop(a)
        assert len(glob.glob(f"{at}/*")) == 1 and b.count() == 5
    assert not glob.glob(at)
