"""Streams of changes applied to an index, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from canopy.config import Config
from canopy.operators.build import Index
from canopy.operators.update import delete, insert
from canopy.sources.points import dims

#: Versions of a saved index that are kept.
VERSIONS = 2


class LiveIndex:
    """Holds the newest version of an index.

    With ``path``, each batch leaves a version of the index there under its epoch,
    and the mark of the version is written last: after a restart of the process
    ``LiveIndex.open`` goes on from the newest marked version, and a batch that the
    stream brings again is passed over.
    """

    def __init__(self, index: Index, path: str | None = None, applied: int = -1, saved: bool = False):
        self.index, self.path, self.applied = index, path, applied
        if path and not saved:
            self._save()

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: Config | None = None) -> LiveIndex:
        applied = spark.read.schema("epoch long").parquet(f"{path}/applied").agg(F.max("epoch")).first()[0]
        return cls(Index.load(spark, f"{path}/epoch={applied}", config), path, applied, saved=True)

    def _save(self) -> None:
        """Write the index as the version of its epoch, then the mark."""
        self.index.save(f"{self.path}/epoch={self.applied}")
        spark = self.index.points.sparkSession
        spark.createDataFrame([(self.applied,)], "epoch long").write.mode("append").parquet(f"{self.path}/applied")

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """Insert, then delete; a batch that was applied already (after a restart of the stream) is passed over."""
        if epoch <= self.applied:
            return
        cols = dims(self.index.points)
        changes = batch.select("op", "id", *cols).persist()
        self.index = insert(self.index, changes.where("op = 'insert'").drop("op"))
        self.index, _ = delete(self.index, changes.where("op = 'delete'").drop("op"))
        changes.unpersist()
        self.applied = epoch
        if self.path:
            self._save()
            spark = self.index.points.sparkSession
            self.index = Index.load(spark, f"{self.path}/epoch={epoch}", self.index.config)
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/epoch={epoch - VERSIONS}")
            old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)


def follow(live: LiveIndex, changes: DataFrame, checkpoint: str) -> StreamingQuery:
    """Start a stream of (op, id, d0, ...) rows into ``live``."""
    return changes.writeStream.foreachBatch(live.apply).option("checkpointLocation", checkpoint).start()
