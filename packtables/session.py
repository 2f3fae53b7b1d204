"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings the library assumes. AQE re-plans joins and coalesces partitions at
# runtime and splits skewed sort-merge join partitions; UTC keeps timestamps
# comparable with the DuckDB oracle.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # lists in the state of streams (event-time TTL) need this store
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # checkpoint files go when their frame does
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, app: str = "packtables",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, taken from the session.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder. Only a
    local-mode session without one (tests, the bench) gets a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running packtables jobs")
    path = tempfile.mkdtemp(prefix="packtables-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: How rows that stay where they were dealt are planned: adaptive execution forgets how its results are partitioned, and a join whose
#: sides are dealt by some of its keys is not to deal them anew.
_DEALT = {"spark.sql.adaptive.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false"}


def cut_dealt(df: DataFrame) -> DataFrame:
    """``cut_lineage`` of rows dealt out by a ``repartition`` on keys: windows, groups and joins on these keys and others need no shuffle afterwards."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k) for k in _DEALT}
    try:
        for k, v in _DEALT.items():
            conf.set(k, v)
        return cut_lineage(df)
    finally:
        for k, v in before.items():
            conf.set(k, v)


def measured(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` that broadcasts a join side only once its rows are measured, never by an estimate.

    Estimates follow the bytes of the Parquet files that a table was derived from, through checkpoints too. A few MB of keys can stand
    for a GB of texts, which a join would gather in the driver. Adaptive execution still broadcasts a side whose shuffled rows
    are below the limit.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    if own.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
        own.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return own


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
