"""Session helpers.

The library never creates machine-local scratch space on a cluster: lineage
is cut with ``DataFrame.checkpoint()`` into the shared folder named by
``spark.checkpoint.dir``. Only a local-mode session without that setting
(tests, single-node benchmark) gets a fresh temporary folder.
"""

from __future__ import annotations

import tempfile
import threading
from contextlib import contextmanager

from pyspark.sql import SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "capaflow", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(SESSION_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only in local mode.

    On a cluster the folder must come from ``spark.checkpoint.dir`` (a shared
    file system); a missing setting there is an error, never a silent local
    fallback.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/object store) so checkpoints survive executor loss")
    path = tempfile.mkdtemp(prefix="capaflow-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


SHUFFLE_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_CLEANED: dict = {}   # session -> [writes that run, the setting before them]
_CLEANED_LOCK = threading.Lock()


@contextmanager
def shuffles_removed(spark):
    """Writes inside remove their shuffle files when they end; left alone, these stay on disk until the driver's JVM
    happens to collect the plan. Not for frames that are run more than once."""
    key = spark._jsparkSession.sessionUUID()
    with _CLEANED_LOCK:   # writes run in several threads of a session
        held = _CLEANED.setdefault(key, [0, spark.conf.get(SHUFFLE_CLEANUP_CONF, None)])
        held[0] += 1
        spark.conf.set(SHUFFLE_CLEANUP_CONF, "true")
    try:
        yield
    finally:
        with _CLEANED_LOCK:
            held[0] -= 1
            if not held[0]:
                del _CLEANED[key]
                if held[1] is None:
                    spark.conf.unset(SHUFFLE_CLEANUP_CONF)
                else:
                    spark.conf.set(SHUFFLE_CLEANUP_CONF, held[1])


STAGE_FORMAT_CONF = "capaflow.stage.format"
_ON_THE_WAY = threading.local()


def stage_table(df, name: str = "stage"):
    """Cut lineage: materialise ``df`` in the shared checkpoint folder.

    Default (``capaflow.stage.format=parquet``): write Parquet under that folder
    and read it back -- the plan runs once and later scans get column pruning
    and filter pushdown. ``checkpoint``: a reliable ``DataFrame.checkpoint()``,
    whole rows in row format, which Spark removes once nothing refers to it.
    Either way the files live on the cluster's shared file system, so a lost
    executor loses nothing.
    """
    import uuid
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if spark.conf.get(STAGE_FORMAT_CONF, "parquet") != "parquet":
        return df.checkpoint(eager=True)
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    paths = getattr(_ON_THE_WAY, "paths", None)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(spark, make, finish):
    """``finish`` of the frame that ``make`` returns; what ``make`` staged on the way (in this thread) is deleted then.

    Nothing that ``make`` stages may be kept beyond it; ``finish`` must have written all that it returns.
    """
    from capaflow.sources.files import delete
    outer, made = getattr(_ON_THE_WAY, "paths", None), []
    _ON_THE_WAY.paths = made
    try:
        df = make()
    finally:
        _ON_THE_WAY.paths = outer
    out = finish(df)
    for path in made:
        delete(spark, path)
    return out


BROADCAST_ROWS_CONF = "capaflow.rank.maxOffsetRowsToBroadcast"


def few_rows(staged) -> bool:
    """Whether a staged table has few enough rows for a broadcast."""
    most = int(staged.sparkSession.conf.get(BROADCAST_ROWS_CONF, "2000000"))
    return staged.limit(most + 1).count() <= most


def broadcast_checked(staged):
    """A staged table, marked for broadcast if its counted rows are few; else as it is, for Spark to choose."""
    from pyspark.sql import functions as F
    return F.broadcast(staged) if few_rows(staged) else staged


def concurrently(*jobs):
    """Results of independent jobs, run at the same time from threads of the driver: small jobs leave most of a cluster idle."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target
    spark = SparkSession.getActiveSession()
    with ThreadPoolExecutor(len(jobs)) as pool:
        futures = [pool.submit((inheritable_thread_target(spark) if spark else inheritable_thread_target)(job)) for job in jobs]
        return [f.result() for f in futures]


def remove_staged(spark: SparkSession) -> None:
    """Delete the tables that this session's jobs staged under the checkpoint folder. To be called at the end, once
    every result that reads them is written."""
    from capaflow.sources.files import delete
    base = ensure_checkpoint_dir(spark).rstrip("/")
    for name in ("tables", "llm"):
        delete(spark, f"{base}/{name}")
