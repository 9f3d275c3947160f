"""Session defaults and staging of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Staging folders of local sessions that name none, by application.
_LOCAL_ROOTS: dict[str, str] = {}


def local_session(app: str = "tidemill", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def staging_root(spark: SparkSession) -> str:
    """The shared folder for staged tables: ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; a cluster has to
    name a folder every executor can reach.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        app = spark.sparkContext.applicationId
        root = _LOCAL_ROOTS.get(app) or _LOCAL_ROOTS.setdefault(app, tempfile.mkdtemp(prefix="tidemill-"))
    return root.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a DataFrame to the shared folder and continue from the stored table.

    Used after an expensive shuffle whose result feeds several jobs.  The stored
    table survives lost executors and, being Parquet, keeps column pruning and
    filter pushdown for every later pass.  Like a checkpoint, it stays until the
    folder's owner removes it, since lazy results may still read it.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/tidemill/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
