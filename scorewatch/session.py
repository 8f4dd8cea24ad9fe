"""Session construction and the shared scratch location.

Everything the library writes outside a user-given path (stream checkpoints,
stream outputs of the self-checking queries, lineage cuts) goes below the
folder the cluster names in ``spark.checkpoint.dir``. A local folder is only
created when that setting is absent *and* Spark runs in local mode (tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults for every session built here. AQE re-plans joins and coalesces
# shuffle partitions at run time; skew-join splitting stays on; days are cut
# in UTC so that window days equal the NTZ days of the stored tables.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

_HANDED_OUT: list[str] = []


def build_session(master: str | None = None, app: str = "scorewatch",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``.

    Set only when unset and running in local mode; on a cluster an unset
    value is an error, because a machine-local folder would not survive the
    loss of the executor that wrote it.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if d:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)
        return d
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    d = tempfile.mkdtemp(prefix="scorewatch-ckpt-")
    sc.setCheckpointDir(d)
    return d


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, unused folder below the shared folder."""
    base = shared_dir(spark).rstrip("/")
    path = f"{base}/scorewatch/{name}-{uuid.uuid4().hex}"
    _HANDED_OUT.append(path)
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: generated
    values are fixed and a lost executor recomputes nothing before this point."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_scratch(spark: SparkSession) -> int:
    """Delete the folders that ``fresh_dir`` handed out in this process; returns how
    many. Call it when no frame that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    n = 0
    while _HANDED_OUT:
        path = jvm.org.apache.hadoop.fs.Path(_HANDED_OUT.pop())
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        n += bool(fs.delete(path, True))
    return n


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def small_frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table built on the driver (a parameter grid, grid results).

    Goes through pandas and Arrow, whose batches the JVM decodes itself: no
    Python worker is started, unlike a DataFrame built from a Python list.
    """
    import pandas as pd
    from pyspark.sql.types import StructType

    st = StructType.fromDDL(schema)
    return spark.createDataFrame(pd.DataFrame(rows, columns=st.fieldNames()), st)
