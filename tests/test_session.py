import os

import pytest

from tessera import session
from tessera.llm.suffix import SuffixIndex


def test_stored_tables_can_be_removed(spark):
    df = session.stored(spark.range(10).repartition(3), "x")
    files = [f.removeprefix("file://") for f in df.inputFiles()]
    assert df.count() == 10 and df.dtypes == spark.range(1).dtypes and files and all(map(os.path.exists, files))
    session.clean(spark)
    assert not any(map(os.path.exists, files)) and not session._written
    assert session.stored(spark.range(3), "x").count() == 3


def test_shared_folder_comes_from_the_session(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    session.ship(spark)
    session.ship(spark)
    assert session.partitions(spark) == 8


def test_without_a_shared_folder_the_warehouse_serves():
    def session_of(**conf):
        class Conf:
            def get(self, key, default=None):
                return conf.get(key.rpartition(".")[0].rpartition(".")[2] + "_" + key.rpartition(".")[2], default)

        return type("Session", (), {"conf": Conf()})()

    where = lambda **conf: session.shared_dir(session_of(**conf))
    assert where(warehouse_dir="file:/w/") == where(warehouse_dir="file:/w", spark_master="local[4]") == "file:/w/_shared"
    assert where(warehouse_dir="hdfs://h/w", spark_master="yarn") == "hdfs://h/w/_shared"
    assert where(warehouse_dir="/w", spark_master="yarn", fs_defaultFS="hdfs://h") == "/w/_shared"
    for warehouse in ("file:/w", "/w"):  # a machine's own disk
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            where(warehouse_dir=warehouse, spark_master="spark://h:7077")
        assert where(warehouse_dir=warehouse, spark_master="spark://h:7077", checkpoint_dir="hdfs://h/c/") == "hdfs://h/c"


def _files(path):
    return [os.path.join(d, f) for d, _, names in os.walk(path.removeprefix("file:").replace("//", "/")) for f in names]


def test_tables_of_our_own_have_no_files_of_checksums(spark, tmp_path):
    """On a local disk each would start a process, which shares the executor's memory while it starts."""
    rows = spark.range(20).repartition(4).selectExpr("id AS home", "id % 2 AS kind")
    session.stored(rows, "x", "kind")
    SuffixIndex(spark, f"file:{tmp_path}/index", size=1 << 20)._write(rows, f"file:{tmp_path}/level", "home", "kind")
    for path in (session._written[-1], f"file:{tmp_path}/level"):
        found = _files(path)
        assert any(f.endswith(".parquet") for f in found) and not [f for f in found if f.endswith(".crc")]
        assert spark.read.parquet(path).count() == 20


def test_a_file_system_named_by_the_user_stays(spark):
    spark.conf.set("fs.file.impl", "org.apache.hadoop.fs.LocalFileSystem")
    try:
        session.stored(spark.range(3), "x")
    finally:
        spark.conf.unset("fs.file.impl")
    assert [f for f in _files(session._written[-1]) if f.endswith(".crc")]


def test_few_rows_go_to_few_files(spark):
    assert [session.files_for(spark, n) for n in (0, 1, 1 << 14, (1 << 14) + 1, 1 << 17, 1 << 40)] == [1, 1, 1, 2, None, None]
    rows = spark.range(1000).repartition(8, "id")
    for dealt in (False, True):
        df = session.stored(rows, "x", files=2, dealt=dealt)
        assert len(df.inputFiles()) == 2 and sorted(r.id for r in df.collect()) == list(range(1000))
