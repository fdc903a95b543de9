"""Where tables between steps are written: a folder that all executors reach."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths that this driver made and hasn't dropped.
_made: dict[str, SparkSession] = {}


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, a temporary folder on a local master and the warehouse on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"file://{tempfile.mkdtemp(prefix='plantables-')}" if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def drop(path: str) -> None:
    spark = _made.pop(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def dropping(keep: Sequence[DataFrame] = ()) -> Iterator[None]:
    """Drops the tables made inside, but for those that the tables in keep (filled inside) are read from."""
    before = set(_made)
    yield
    used = {f.rsplit("/", 1)[0] for df in keep for f in df.inputFiles()}
    for path in set(_made) - before:
        if not any(u.endswith(path.split("://")[-1]) for u in used):
            drop(path)


@atexit.register
def drop_made() -> None:
    """Drops all tables of this driver; results that read them are gone then. The driver's end calls it as well."""
    for path in list(_made):
        try:
            drop(path)
        except Exception:  # noqa: BLE001  the session, or its JVM, ended first
            _made.pop(path, None)


def written(df: DataFrame, what: str) -> DataFrame:
    """The table, written and read again, so that its lineage ends."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
