"""Session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "morrowgrid", **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; conf overrides (dots as double underscores)."""
    b = SparkSession.builder.appName(app)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false"}.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset and driver and executors are one process, as in tests."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        where = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df):
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
