"""Session helpers: settings the library relies on, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job here assumes: UTC for date texts, AQE for runtime re-planning.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # call sites of columns are not recorded: they cost most of the time in
    # which a wide plan is built
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # wide compiled mappings produce large generated methods; above ~8 KB of
    # bytecode the JVM will not JIT a method, so fall back to split code early
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: str = "8", shuffle_partitions: str = "8", app: str = "weft") -> SparkSession:
    """A local session for tests and benchmarks (a cluster session comes from the caller)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.driver.memory", "16g")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only when unset (tests,
    local runs) a scratch folder is chosen.  On a cluster the setting must name
    shared storage: executors don't see each other's local folders."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="weft-ckpt-", dir=os.environ.get("WEFT_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


def materialize(df):
    """Cut lineage of an intermediate used several times: write it once as a
    parquet table under the shared ``spark.checkpoint.dir`` and read it back.
    One columnar job (``checkpoint()`` would compute twice and serialise rows);
    the table survives executor loss, unlike a local checkpoint or a cache."""
    import uuid

    spark = df.sparkSession
    path = scratch_path(spark, f"materialized/{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
