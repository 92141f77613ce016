"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
_registered: list[bool] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of this machine serves a session that runs on this machine alone; a
    cluster's executors could not see each other's files there, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file:///tmp/checkpoints/quantspark"
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path; what is written there is read lazily, so it is removed when the driver ends, not before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if not _registered:
        atexit.register(_remove)
        _registered.append(True)
    _made.append(path)
    return path


def _remove(paths: list[str] | None = None) -> None:
    with contextlib.suppress(Exception):  # the session may have ended already
        spark = SparkSession.getActiveSession()
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _made if paths is None else paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


class Scratch:
    """Tables made inside the block are removed at its end, but for those kept: what is kept must be written, not only
    planned, as it can't be computed anew from what is gone."""

    def __enter__(self) -> Scratch:
        self.first, self.kept = len(_made), set()
        return self

    def keep(self, made: str | DataFrame):
        """A folder, or a table that `stored` returned."""
        self.kept.add(made if isinstance(made, str) else made.stored_at)
        return made

    def __exit__(self, *_: object) -> None:
        gone = [p for p in _made[self.first :] if p not in self.kept]
        _remove(gone)
        _made[self.first :] = [p for p in _made[self.first :] if p in self.kept]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out
