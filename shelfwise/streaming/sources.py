"""The ``events`` table read as a stream, and where stream output goes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import scratch_path


def _is_folder(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def event_schema(spark: SparkSession, sf_dir: str):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """``events.parquet`` of a folder as a file stream (schema taken from the data).

    A folder of part files is watched as a whole, so files that arrive later are read too.  A single file
    is picked out of its folder by name, because the file source wants a folder.
    """
    root = sf_dir.rstrip("/")
    reader = spark.readStream.schema(event_schema(spark, sf_dir))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if _is_folder(spark, f"{root}/events.parquet"):
        return reader.parquet(f"{root}/events.parquet")
    return reader.option("pathGlobFilter", "events.parquet").parquet(root)


def run_available(stream_df: DataFrame, label: str, write_batch, output_mode: str = "update", location: str | None = None) -> str:
    """Process everything available, batch by batch, and stop; returns the output folder.

    ``location`` holds output and checkpoint.  Calling again with the same location resumes where the last
    committed batch ended; without one, a new folder of the session's shared checkpoint folder is taken.
    ``write_batch(batch, epoch, folder)`` must be repeatable: a batch whose commit was lost runs again.
    """
    spark = stream_df.sparkSession
    out = location.rstrip("/") if location else scratch_path(spark, label)
    query = (stream_df.writeStream.outputMode(output_mode)
             .option("checkpointLocation", f"{out}/checkpoint")
             .foreachBatch(lambda batch, epoch: write_batch(batch, epoch, out))
             .trigger(availableNow=True)
             .start())
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(f"stream {label} failed: {query.exception()}")
    return out


def write_epoch(batch: DataFrame, epoch: int, folder: str) -> None:
    """One folder per epoch, overwritten when the epoch runs again."""
    batch.write.mode("overwrite").parquet(f"{folder}/epoch={epoch:09d}")


def read_epochs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What all epochs have written, with ``epoch``; no rows where no batch has run yet."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], schema + ", epoch int")
    return spark.read.schema(schema + ", epoch int").option("basePath", folder).parquet(folder)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


class Sums:
    """Totals per key that epochs add to: one delta per epoch, and every ``EVERY`` epochs a snapshot of all sums so far.

    Sums are mergeable, so the order in which rows arrive does not matter and no row is ever late. A reader takes the last
    snapshot and the deltas behind it: at most ``EVERY`` folders, however many epochs there have been. A repeated epoch writes
    the same again, as its delta comes from the same rows and its snapshot from earlier ones.
    """

    EVERY = 16

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str]):
        self.spark, self.folder, self.schema, self.keys = spark, folder.rstrip("/"), schema, keys
        self.sums = [c.split()[0] for c in schema.split(", ") if c.split()[0] not in keys]

    def _merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.sums])

    def _epochs(self, kind: str) -> list[int]:
        """The finished epochs of a kind; folder names only."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [f.getPath() for f in fs.listStatus(root)]
        done = [p for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def folders(self, before: int | None = None) -> list[str]:
        """What a reader of all epochs (``before`` one) reads."""
        last = max([e for e in self._epochs("snapshot") if before is None or e < before], default=-1)
        deltas = [e for e in self._epochs("delta") if e > last and (before is None or e < before)]
        return [f"{self.folder}/snapshot/epoch={last:09d}"] * (last >= 0) + [f"{self.folder}/delta/epoch={e:09d}" for e in deltas]

    def read(self, before: int | None = None) -> DataFrame:
        folders = self.folders(before)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self._merged(self.spark.read.schema(self.schema).parquet(*folders))

    def add(self, delta: DataFrame, epoch: int) -> DataFrame:
        """Write one epoch's sums; returns them, read back."""
        write_epoch(self._merged(delta), epoch, f"{self.folder}/delta")
        if (epoch + 1) % self.EVERY == 0:
            # from earlier snapshots only: one of this epoch may be left from a run whose commit was lost
            earlier = self.folders(epoch) + [f"{self.folder}/delta/epoch={epoch:09d}"]
            write_epoch(self._merged(self.spark.read.schema(self.schema).parquet(*earlier)), epoch, f"{self.folder}/snapshot")
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/delta/epoch={epoch:09d}")
