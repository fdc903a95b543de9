"""What the training-data operators share: tables that cut lineage, and scans."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key columns times rows of an id set that may be broadcast, up to this number (8 bytes each); a larger one is joined by shuffle.
BROADCAST_IDS = 2_000_000

#: Scratch paths that this driver made and hasn't dropped.
_made: dict[str, SparkSession] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors reach: spark.checkpoint.dir, by default.

    Only where that is unset, a local master gets a temporary folder and a
    cluster the warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.startswith("local"):
            folder = f"file://{tempfile.mkdtemp(prefix='plantables-')}"
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_folder(spark)}/plantables/{what}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _made.pop(path, None)


@contextmanager
def dropping(keep: list[str]) -> Iterator[None]:
    """Drops the scratch tables made inside, but for those whose paths are put into keep."""
    before = set(_made)
    yield
    for path in set(_made) - before - set(keep):
        drop_path(_made[path], path)


@atexit.register
def drop_made() -> None:
    """Drops all scratch tables of this driver. A result that reads them is gone then: call it after the last use, else the driver's end does."""
    for path, spark in list(_made.items()):
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session, or its JVM, ended first
            _made.pop(path, None)


class Cut:
    """A table written to the shared folder and read again.

    Lost executors don't matter to later reads, and lineage ends here.
    """

    def __init__(self, df: DataFrame, what: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, what)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def cut(df: DataFrame, what: str) -> DataFrame:
    return Cut(df, what).df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def only_ids(df: DataFrame, ids: DataFrame, on: str | Sequence[str], keep: bool = True) -> DataFrame:
    """Rows of df whose id (or ids together) is (or isn't) among ids, without moving df while the ids are few.

    The ids are counted; past BROADCAST_IDS the same join is done by shuffle.
    """
    small = ids.count() * len(ids.columns) <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids.hint("shuffle_hash"), on if isinstance(on, str) else list(on), "left_semi" if keep else "left_anti")
