"""Where lineage is cut."""

from pathlib import Path

import pyarrow as pa
import pytest

from crawlatlas import session


class Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class FakeContext:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class FakeSession:
    def __init__(self, master, conf=None, folder=None):
        self.conf, self.sparkContext = Conf(conf or {}), FakeContext(master, folder)


def test_the_named_folder_wins():
    named = FakeSession("yarn", {"spark.checkpoint.dir": "hdfs://shared/ck/"})
    assert session.shared_dir(named) == "hdfs://shared/ck"
    assert session.scratch(named, "x").startswith("hdfs://shared/ck/crawlatlas/x-")


def test_a_cluster_never_falls_back_to_a_local_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(FakeSession("yarn"))


def test_local_sessions_make_their_own():
    local = FakeSession("local[2]")
    first = session.shared_dir(local)
    assert first == session.shared_dir(local)


def test_materialize_reads_back_what_it_wrote(spark):
    df = spark.range(5)
    out = session.materialize(df, "t")
    assert out.schema.simpleString() == df.schema.simpleString() and out.count() == 5


def test_discarded_tables_are_gone(spark):
    table = session.materialize(spark.range(5), "kept")
    folder = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert table.count() == 5 and Path(folder).exists()
    session.discard(table, spark.range(1))
    assert not Path(folder).exists()


def test_batches_are_bounded_by_bytes(spark):
    """Rows of long texts reach Python in batches of about the stated size."""
    long = spark.range(300, numPartitions=1).selectExpr("repeat('x', 200000) AS t")
    sizes = [r[0] for r in long.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]
    assert sum(sizes) > 50_000_000 and max(sizes) < 6_000_000
