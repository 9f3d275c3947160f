import pytest

from tidemill import session


class FakeConf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.value or default


class FakeSpark:
    def __init__(self, value, master):
        self.conf = FakeConf(value)
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})


def test_the_named_folder_is_used():
    assert session.staging_root(FakeSpark("hdfs://shared/cp/", "yarn")) == "hdfs://shared/cp"


def test_a_cluster_must_name_one():
    with pytest.raises(RuntimeError):
        session.staging_root(FakeSpark(None, "yarn"))


def test_a_local_session_gets_one():
    spark = FakeSpark(None, "local[2]")
    assert session.staging_root(spark) == session.staging_root(spark)


def test_staged_tables_keep_rows_and_types(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 2.5)], "`a b` int, s string, `x.y` double")
    staged = session.stage(df, "test")
    assert staged.schema == df.schema and sorted(staged.collect(), key=str) == sorted(df.collect(), key=str)
