"""Shared storage for intermediate tables.

Everything that cuts lineage is written as Parquet below the folder that the
cluster names in ``spark.checkpoint.dir``, by Spark's own writers, so that any
executor (or a replacement for a lost one) can read it again.
"""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables.

    Reads ``spark.checkpoint.dir``.  Only a single-JVM ``local`` session may go
    without: it gets a temporary folder of its own, set in the session so that
    later calls share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="canopy-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Deletes the files of a query's shuffles when it ends, not when the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back; the files of its shuffles are deleted."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/canopy/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(TIDY, before) if before else spark.conf.unset(TIDY)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``settle`` wrote, once nothing reads them any more; others are left alone."""
    for table in tables:
        spark = table.sparkSession
        own = posixpath.join(shared_root(spark), "canopy") + "/"
        bare = own.removeprefix("file:").lstrip("/")
        for folder in {posixpath.dirname(f) for f in table.inputFiles()}:
            if bare in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
