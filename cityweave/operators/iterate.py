"""What iterative jobs keep between rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a temporary one set only where that is
    missing and the master is local, as in tests."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that neither plans nor lineage grow."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Rounds:
    """Tables of an iteration, written to the shared folder and read back; what no later round reads is deleted there."""

    def __init__(self) -> None:
        self.held: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame, last: bool = False) -> DataFrame:
        """df written and read back; with last it stays when others go."""
        spark, path = df.sparkSession, new_path(df.sparkSession, "round")
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
        if not last:
            self.held.append((out, path))
        return out

    def tidy(self, *still: DataFrame) -> None:
        """Delete the tables kept so far but those still in use."""
        for df, path in self.held:
            if not any(df is s for s in still):
                at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
        self.held = [h for h in self.held if any(h[0] is s for s in still)]
