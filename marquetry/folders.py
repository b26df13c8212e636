"""Intermediate tables: where they go, and when they are deleted."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Where that is unset, a folder of this machine is used if all of Spark runs on it, as in tests; on a cluster this fails.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return f"{sc.getCheckpointDir()}/work-{uuid.uuid4()}"


#: Paths of the tables that written() made and that are still there, with their sessions.
_written: dict[str, SparkSession] = {}


def written(df: DataFrame) -> DataFrame:
    """Writes the rows as Parquet below the shared folder, and reads them from there.  The table goes with discard(), or at the end of the program."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    _written[path] = df.sparkSession
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def is_written(df: DataFrame) -> bool:
    """Whether the rows can be read again without being computed again."""
    return hasattr(df, "_written_at")


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made; nothing may read them any more."""
    for t in tables:
        _delete(t._written_at)


@atexit.register
def _discard_all() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except (Py4JError, OSError):  # Spark has ended already
            return


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, made longer until no column of df has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
