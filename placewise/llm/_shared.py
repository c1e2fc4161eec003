"""What the corpus operators share: intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a local session (tests) gets one temporary
    folder, and a cluster an error: its executors share no local folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("placewise.scratch", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("placewise.scratch", where)
    return where.rstrip("/")


#: What was observed of a written table.
_SEEN: WeakKeyDictionary = WeakKeyDictionary()


def seen(df: DataFrame) -> dict:
    """Of a table that ``Scratch.cut`` returned: ``count`` and what else was observed of it; empty for others."""
    return _SEEN.get(df, {})


#: The folder that scratch tables go below, in this thread or task; None: the shared one itself.
_AREA: ContextVar[str | None] = ContextVar("area", default=None)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch_area(spark: SparkSession, name: str):
    """Scratch tables made within go to a folder of their own, which is deleted at the end; write results before."""
    path = f"{_AREA.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = _AREA.set(path)
    try:
        yield
    finally:
        _AREA.reset(before)
        delete(spark, path)


class Scratch:
    """Cuts lineage by writing a table to the shared folder and reading it again.

    A lost executor costs only the tasks since the last written table. ``drop`` removes a table
    that later steps no longer read.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{_AREA.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, tuple[DataFrame, str]] = {}  # holds the table, so that its id stays its own
        self._n = 0

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{label}"

    def cut(self, df: DataFrame, label: str, rows: str | None = None, **sums: Column) -> DataFrame:
        """The table written and read again. Its number of rows, the sum and the largest of the column ``rows`` and ``sums``
        are observed as it is written and can be had by ``seen`` without another job."""
        path = self.path(label)
        if rows is not None:
            sums |= {"total": F.sum(rows), "most": F.max(rows)}
        watch = Observation()
        df.observe(watch, F.count(F.lit(1)).alias("count"), *[c.alias(k) for k, c in sums.items()]).write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = (back, path)
        _SEEN[back] = {k: v or 0 for k, v in watch.get.items()} | {"by": rows}
        return back

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _, path = self._paths.pop(id(df), (None, None))
            if path:
                delete(self.spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name += "_"
    return name


def held_out(id_col) -> Column:
    """crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


ROWS_AT_ONCE = 512
BROADCAST_ROWS = 1_000_000


def short_batches(spark: SparkSession, rows: int = ROWS_AT_ONCE) -> None:
    """Rows go to Python at most ``rows`` at once from now on, in the session, since results are lazy; a session's own
    smaller number stays. A batch of Spark's 10,000 texts lies in the JVM and in the worker of each task, beside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:  # zero and less: no limit
        spark.conf.set(key, str(rows))


def slices(batches, rows: int = ROWS_AT_ONCE):
    """Arrow batches of fewer rows, so that a task holds few texts as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if its rows, of a few numbers each, are counted to be few; else as it is."""
    count = seen(df)["count"] if seen(df) else df.count()
    return F.broadcast(df) if count <= rows else df


HOT_ROWS = 512
HOT_KEYS = 100_000


def hot_limit(counts: DataFrame, rows: str = "rows", keys: int = HOT_KEYS) -> tuple[int, bool]:
    """``(limit, any)``: a key of more rows than ``limit`` is hot; whether there is one.

    The limit is ``HOT_ROWS`` or a ``keys``-th of all rows, whichever is more, so fewer than ``keys`` keys are
    hot in a table of any size: a proven bound for a broadcast. ``counts`` has a key's number of rows in ``rows``.
    """
    known = seen(counts)
    if known.get("by") == rows:
        total, most = known["total"], known["most"]
    else:
        total, most = counts.agg(F.coalesce(F.sum(rows), F.lit(0)), F.coalesce(F.max(rows), F.lit(0))).first()
    limit = max(HOT_ROWS, total // keys)
    return limit, most > limit


def join_keyed(
    left: DataFrame, right: DataFrame, key: str | list[str], rows: str = "rows", how: str = "inner", keep: bool = False, keys: int = HOT_KEYS, hint: str | None = None
) -> DataFrame:
    """``left`` joined with ``right``, a written table of one short row per key with the key's ``rows`` in ``left``.

    Rows of hot keys are joined where they lie, to a broadcast of those keys alone; the others are shuffled, so no
    task gets a large share of one key. ``how`` is inner or left. ``rows`` is returned only to ``keep`` it. Fewer
    than ``keys`` keys are broadcast: give less than ``HOT_KEYS`` where keys are long. ``hint`` is how the others are joined.
    """
    joined = lambda rows, by: rows.join(by.hint(hint) if hint else by, key, how)
    limit, any_hot = hot_limit(right, rows, keys)
    gone = [] if keep else [rows]
    if not any_hot:
        return joined(left, right.drop(*gone))
    cold, hot = right.filter(F.col(rows) <= limit).drop(*gone), right.filter(F.col(rows) > limit).drop(*gone)
    rest = joined(left.join(F.broadcast(hot.select(key)), key, "left_anti"), cold)
    return left.join(F.broadcast(hot), key).unionByName(rest)
