"""Session helpers: a local session for tests and benches, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "hearthline", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A single-JVM session. On a cluster the session comes from spark-submit instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.streaming.metricsEnabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


JIT_METHOD_LIMIT = "8000"
#: Shuffled bytes that adaptive execution merges for one task. Lines of some 12 bytes become members of
#: some 500 within a stage, so a task of the usual 64 MB would sort gigabytes.
TASK_BYTES, USUAL_TASK_BYTES = "8MB", 64 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings for wide survey rows.

    The JVM never compiles a method above 8000 bytes of bytecode, so one fused method per
    stage, which a projection of 100 columns easily exceeds, would run interpreted. With
    this limit Spark falls back to many small compiled methods for exactly those stages.

    Rows also grow wide within a stage, so fewer bytes are merged for a task than is usual. Settings
    of the session's own are left alone.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name) == "65535":
        spark.conf.set(name, JIT_METHOD_LIMIT)
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark.conf.get(name) in ("64MB", f"{USUAL_TASK_BYTES}b", str(USUAL_TASK_BYTES)):
        spark.conf.set(name, TASK_BYTES)
    return spark


def spread(df: DataFrame, key: str) -> DataFrame:
    """Redistribute a scan that has fewer splits than the cluster has cores.

    A small file, or one with a single row group, is read by one task, and everything up to
    the next shuffle would stay there. Tables with enough splits pass through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for `purpose` below the cluster's shared checkpoint folder."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; folders of a fixed name there outlive a session.

    A local session without the setting gets a temporary folder; a cluster without it
    is an error, because executors could not see one another's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="hearthline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` as a table written once to the shared folder, for results that are read several
    times. It survives lost executors, is scanned with column pruning, and tells the planner
    its size; a checkpoint would compute the result twice and keep whole rows."""
    path = shared_dir(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Independent fits that run at once: their jobs are short and leave cores idle, but each keeps its rows in storage.
FITS_AT_ONCE = 3


def side_by_side(work: Sequence[Callable], at_once: int = FITS_AT_ONCE) -> list:
    """Results of independent pieces of driver work, in order, `at_once` of them submitting jobs at a time."""
    session = SparkSession.getActiveSession()
    inherit = inheritable_thread_target(session) if session else inheritable_thread_target
    with ThreadPoolExecutor(at_once) as pool:
        return [f.result() for f in [pool.submit(inherit(w)) for w in work]]
