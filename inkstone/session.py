"""Session helpers: a local session for tests and benches, and durable intermediate tables.

Intermediate results that are read more than once are written as Parquet below the folder
named by ``spark.checkpoint.dir`` (shared by all executors), so a lost executor costs a
re-read and not a recomputation.  Only where the setting is missing (tests, laptops) is a
temporary folder used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, name: str = "inkstone", shuffle: int = 8) -> SparkSession:
    """A ``local[cpus]`` session configured like the tests and the bench expect it."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``; with a local master a temporary one if unset.

    On a cluster a machine-local folder would lose rows, so a missing setting is an error there.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        known = f"file://{tempfile.mkdtemp(prefix='inkstone-')}"
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system remove a table when the driver ends; where that is not to be had, it stays."""
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).deleteOnExit(where)
    except Exception:  # noqa: BLE001 - no JVM at hand, as with a remote session
        pass


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a reader of it.

    Cuts the lineage: the result survives the loss of any executor.  The table is removed
    when the driver ends, since a plan that reads it may be run until then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def latest(df: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """Each key once, with the columns of its latest delivery (ties, and without a time: the largest by hash)."""
    row = F.struct(*columns)
    time = [F.col(at)] if at in df.columns else []
    return df.groupBy(key).agg(F.max_by(row, F.struct(*time, F.xxhash64(row))).alias("_row")).select(key, *[F.col("_row")[c].alias(c) for c in columns])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
