import os

import pytest

from sievework import session


class Context:
    def __init__(self, master):
        self.master = master


class Session:
    def __init__(self, master, conf):
        self.conf, self.sparkContext = conf, Context(master)


def test_the_folder_of_the_cluster_is_used():
    assert session.shared_folder(Session("yarn", {"spark.checkpoint.dir": "/shared"})) == "/shared"
    assert session.shared_folder(Session("local[2]", {"spark.checkpoint.dir": "/shared"})) == "/shared"


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session("yarn", {}))


def test_stored_tables_cut_the_lineage(spark):
    stored = session.materialise(spark.range(5).selectExpr("id", "id * 2 AS twice"))
    assert sorted(r["twice"] for r in stored.collect()) == [0, 2, 4, 6, 8]
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Range" not in plan
    assert os.path.isdir(session.shared_folder(spark))
