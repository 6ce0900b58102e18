"""Session factory and the table loader that every query shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of up to this many bytes may be broadcast; larger sides are shuffled.
BROADCAST_BYTES = 32 << 20


def session(app: str = "noteweave", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; `conf` (dots as double underscores) wins over the defaults."""
    b = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": str(BROADCAST_BYTES),
    }
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Give Python stages enough tasks when the scan has few splits.

    A round-robin exchange moves the rows once; it is used only where the work per row is far dearer than moving it,
    and only when the scan yields fewer tasks than the cluster has cores.
    """
    cores = spark.sparkContext.defaultParallelism
    want = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(want)


def shared_folder(spark: SparkSession) -> None:
    """Make sure that checkpoints have a folder that all executors reach.

    The cluster names it in spark.checkpoint.dir. Only a master that runs in this very process may do without it: there a
    temporary folder is set.
    """
    sc = spark.sparkContext
    if sc.getConf().get("spark.checkpoint.dir") is not None or not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor reaches")
    import tempfile

    sc.setCheckpointDir(tempfile.mkdtemp(prefix="noteweave-checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, by a reliable checkpoint in the folder of spark.checkpoint.dir."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
