"""Session settings, table reading and staging shared by all operators."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "threadmill", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the operators expect; on a cluster use the session given."""
    cpus = cpus or os.cpu_count() or 1
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Repartition inputs that have fewer splits than there are cores.

    Only an input smaller than cores x maxPartitionBytes can have so few, so
    the extra shuffle is bounded by the cluster's size and never by the data's.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one is made only where none is set."""
    sc = spark.sparkContext
    got = sc._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get()
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="threadmill-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


#: Paths of staged tables by session.
_staged: dict[str, SparkSession] = {}
#: Names in the catalog of those that have one.
_tables: dict[str, str] = {}


def _delete(spark: SparkSession, path: str) -> None:
    if path in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _drop_staged() -> None:
    for path, spark in list(_staged.items()):
        _staged.pop(path, None)
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            continue


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(_drop_staged)
    _staged[path] = spark
    return path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts the lineage, survives lost executors, and unlike a checkpoint keeps
    column pruning and pushed filters. The tables go with ``unstage``, or when the process ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._threadmill_path = path
    return out


def stage_by(df: DataFrame, key: str, name: str = "stage", placed: bool = False) -> DataFrame:
    """``df`` staged in buckets of ``key``, sorted within, so that joins and groups by it need neither a shuffle nor a sort of this table.

    There are as many buckets as shuffle partitions; ``placed`` says that ``df`` is in such partitions already. The table is in the session's catalog until ``unstage``.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, name)
    own = f"threadmill_{name}_{uuid.uuid4().hex}"
    (df if placed else df.repartition(n, key)).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(own)
    _tables[path] = own
    out = spark.table(own)
    out._threadmill_path = path
    return out


def unstage(*frames: DataFrame | None) -> None:
    """Delete tables that ``stage`` gave back and that nothing will read again, so that a loop holds the room of one round.

    What was computed from them must have been staged or collected already. Frames that were not staged are let be.
    Shuffle files go when the JVM collects the plans they belong to, which it is asked to do.
    """
    for f in frames:
        path = getattr(f, "_threadmill_path", None)
        spark = _staged.pop(path, None)
        if spark is not None:
            _delete(spark, path)
    spark = next((f.sparkSession for f in frames if f is not None), None)
    if spark is not None:
        gc.collect()
        spark._jvm.System.gc()
