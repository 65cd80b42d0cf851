"""Session settings and the helpers that depend on the session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of their values, up to which a dimension may be broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 2**20


def build_session(app: str = "vigil", master: str | None = None, cores: int = 8) -> SparkSession:
    """A session for local work. On a cluster the settings come with spark-submit instead."""
    builder = SparkSession.builder.appName(app)
    builder = builder.master(master or f"local[{cores}]")
    conf = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",  # small local data, all cores
        "spark.sql.files.maxPartitionBytes": "4m",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    session = builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a local session may do without the setting; it then gets a temporary folder that is removed at exit.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="vigil-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


_made: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder. release() removes what is there, at the latest when the driver ends."""
    if not _made:
        atexit.register(_release_at_exit, spark)
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> None:
    """Remove the tables written below the shared folder by this process. Results that were not stored yet cannot be read after."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    while _made:
        path = hadoop(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _release_at_exit(spark: SparkSession) -> None:
    try:
        release(spark)
    except Exception:  # noqa: BLE001 - the session has been stopped, and its folder goes with it or is kept on purpose
        _made.clear()


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: a cut in the lineage that outlives any executor. `by` lays it out in
    parts of that column, of which a filter reads only its own."""
    path = work_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, name: str, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Materialise df; mark it for broadcast only if it has at most `rows` rows and its values at most `most_bytes` bytes, else
    leave the join to the optimizer. Values are fixed-width or text or binary; others count as their JSON text."""
    kept = written(df, name)
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) for c, kind in kept.dtypes if kind in ("string", "binary") or kind.startswith(("array", "map", "struct"))]
    size = sum(wide, F.lit(16 + 8 * len(kept.columns)).cast("bigint"))
    found = kept.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).first()
    return F.broadcast(kept) if found["n"] <= rows and (found["bytes"] or 0) <= most_bytes else kept
