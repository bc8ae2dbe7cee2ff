"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Rows of an Arrow batch.
ARROW_ROWS = 2_000
#: Rows of a few numbers that are broadcast at most; more are shuffled.
BROADCAST_ROWS = 500_000
#: Rows of a few numbers that one file of a small table holds.
FILE_ROWS = 500_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def fresh(names: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, with underscores in front where one is taken
    (whatever the case of its letters)."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w = "_" + w
        taken.add(w.lower())
        out.append(w)
    return out


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of ARROW_ROWS rows, where the session says nothing else, as
    rows are whole texts: batches are held several times over by both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, ARROW_ROWS)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with the memory that a task has freed given back at its end, so that
    idle Python workers, which Spark keeps, hold little."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return task


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset (a local session, as in tests) a temporary folder is set
    once for the session; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file systems, if it is still there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_live: dict[str, SparkSession] = {}
_scopes: list[list[Table]] = []


@atexit.register
def _drop_rest() -> None:
    for path, spark in _live.items():
        try:
            if spark.sparkContext._jsc is not None:
                drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


class Table:
    """A DataFrame written as Parquet in the shared folder, so that a lost
    executor costs a reread and not a recomputation.

    rows: the most rows of a few numbers that it can have, where that is known
    and its last stage reads nothing larger; so small tables are a few files,
    however many partitions made them. Tables
    last until drop(), the end of the scratch() they were made in, or the end
    of the process.
    """

    def __init__(self, df: DataFrame, name: str, rows: int | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.schema = df.schema
        (df if rows is None else df.coalesce(rows // FILE_ROWS + 1)).write.parquet(self.path)
        _live[self.path] = self.spark
        if _scopes:
            _scopes[-1].append(self)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        if _live.pop(self.path, None):
            drop_path(self.spark, self.path)


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    return Table(df, name, rows).df


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of a few numbers a row, marked for broadcast where it has
    no more than so many rows; beyond that a join shuffles both sides."""
    return F.broadcast(df) if df.count() <= most else df


@contextmanager
def scratch() -> Iterator[list[Table]]:
    """Drops at its end the tables made inside it; take out of the list what is
    to stay. Frames that read the others must be written before."""
    own: list[Table] = []
    _scopes.append(own)
    try:
        yield own
    finally:
        _scopes.remove(own)
        for t in own:
            t.drop()
