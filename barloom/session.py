"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime (SQL) settings; safe to apply to a session someone else created.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Work per byte is high here (windows, parameter sets, simulations): merge small
    # partitions only below this size, so that little input still uses all cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    # And never beyond this size: a task holds a row several times (a sorter or buffer
    # per window), many times the bytes of its shuffled form.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4MB",
    # A table hashed on (key, blk) may join on (key, blk, bar_no) without being
    # shuffled again; only the small side moves.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Arrow batches between JVM and Python workers.
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows per batch bound a batch here. With a byte limit too, Spark sums the bytes of all
    # columns anew for every row it writes, more than half of the time of a sweep.
    "spark.sql.execution.arrow.maxBytesPerBatch": "2147483647",
}

STATE_STORE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


# Bytes of input files behind one shuffle partition.
INPUT_PER_PARTITION = 1 << 20


def tune(spark: SparkSession, folder: str | None = None) -> SparkSession:
    """Apply the runtime settings and return the session.

    With the ``folder`` of the input, shuffles get a partition per
    ``INPUT_PER_PARTITION`` bytes of it, so that a task's rows do not grow with the
    input; small partitions are merged as ever. Fewer than the session's own
    number are never set. Streams keep the session's number.
    """
    for name, value in RUNTIME_CONF.items():
        spark.conf.set(name, value)
    if folder is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
        wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // INPUT_PER_PARTITION))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
    return spark


def local_session(cpus: str = "8", app: str = "barloom") -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in {**RUNTIME_CONF, **STATE_STORE_CONF}.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: the session's ``spark.checkpoint.dir``.

    Only a local session (a test) without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="barloom-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
