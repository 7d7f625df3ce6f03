"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import os
import tempfile
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in slices of about this many characters, so that a batch of long texts stays small.
SLICE_CHARS = 2_000_000


T = TypeVar("T")
_kept: dict[tuple, object] = {}


def worker_table(key: tuple, make: Callable[[], T]) -> T:
    """The table that a worker keeps under ``key`` from batch to batch; it keeps one, so a worker that goes on to another operator gives back the memory of the last."""
    if key not in _kept:
        if _kept:
            _kept.clear()
            gc.collect()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # a C library without it
                pass
        _kept[key] = make()
    return _kept[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one on a local master, else ValueError."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandwork-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in whatever store it is; one that isn't there is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Spark's setting by which a query's shuffle files go when it is done, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("_made", default=None)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries planned inside delete their shuffle files when they are done; a file that is asked for again is made again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def checkpoint_folder(df: DataFrame) -> str | None:
    """Where the rows of a ``checkpointed`` table are."""
    found = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    return found.get() if found.isDefined() else None


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder; shuffle files behind it are deleted."""
    shared_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        out = df.select("*").checkpoint(eager=True)  # planned anew, with that setting
    if (made := _made.get()) is not None and (folder := checkpoint_folder(out)):
        made.append(folder)
    return out


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` returns, checkpointed; checkpoints made on the way are deleted, so nothing else that reads them may outlive it."""
    outer, own = _made.get(), []
    token = _made.set(own)
    try:
        with shuffles_dropped(SparkSession.active()):
            out = checkpointed(make())
    finally:
        _made.reset(token)
    kept = checkpoint_folder(out)
    for folder in own:
        if folder != kept:
            remove(out.sparkSession, folder)
    if outer is not None and kept:
        outer.append(kept)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces whose ``text`` columns hold about SLICE_CHARS bytes each, a row at least."""
    column = batch.column(text)
    if batch.num_rows < 2 or column.nbytes <= SLICE_CHARS:
        yield batch
        return
    begun = held = 0
    for i, n in enumerate(pc.binary_length(column).to_pylist()):
        if held and held + (n or 0) > SLICE_CHARS:
            yield batch.slice(begun, i - begun)
            begun, held = i, 0
        held += n or 0
    yield batch.slice(begun)


def map_texts(df: DataFrame, columns: list[str | Column], text: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` over slices of the chosen columns, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                if part.num_rows:
                    yield fn(part)

    return df.select(*columns).mapInArrow(run, schema)


def boundaries(df: DataFrame, key: list[str], blocks: int, over: int = 32, most: int = 200_000) -> list[tuple]:
    """About ``blocks`` - 1 values of ``key`` that occur in ``df`` and cut its sorted order into blocks of like size.

    They are every so many-th of the keys with the smallest hashes; at most ``most`` keys reach the
    driver. Which keys are chosen decides balance alone, never a result. Nulls sort first.
    """
    some = df.select(*key).dropna().distinct().orderBy(F.xxhash64(*key), *key).limit(min(most, over * blocks))
    keys = sorted(tuple(r) for r in some.collect())
    step = max(1, len(keys) // max(1, blocks))
    return keys[step::step][: blocks - 1]


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A public vocabulary file: in ``folder``, or where the installed ``public_tokenizers`` keeps it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
