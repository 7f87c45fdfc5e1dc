"""What the operators share: tables, the shared folder, tables written there and their removal."""

from __future__ import annotations

import ctypes
import functools
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words and are stripped from line ends.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows in a batch that goes to a Python worker: texts may be long, and a worker's memory is small.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus. Sets the session's Arrow batches to BATCH_ROWS where they are larger."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a temporary folder takes its place, under a local master only (as in tests).
    """
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(found := f"file://{tempfile.mkdtemp(prefix='fragmenta-')}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where the tables lie that ``written`` made, and those of the open scratch blocks.
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_scratch: list[set[str]] = []


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What queries within shuffle is removed as soon as each has ended; the session's setting comes back."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends here and survives lost executors.

    ``removed`` deletes it when its last reader is done; what is part of a result stays.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    if _scratch:
        _scratch[-1].add(path)
    return out


class Scratch:
    """What a scratch block hands out, to name the tables that stay."""

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, a table that ``written`` made, outlives the block; it counts to the block around it, if any."""
        path = _folders[df]
        _scratch[-1].discard(path)
        if len(_scratch) > 1:
            _scratch[-2].add(path)
        return df


@contextmanager
def scratch() -> Iterator[Scratch]:
    """Tables written within are removed at its end, but for those kept; results that read others must be written before."""
    _scratch.append(set())
    try:
        yield Scratch()
    finally:
        for path in _scratch.pop():
            remove_folder(path)


def remove_folder(path: str) -> None:
    """Deletes a folder of the shared storage."""
    if "://" not in path or path.startswith("file:"):
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
    else:
        fs, inner = pafs.FileSystem.from_uri(path)
        fs.delete_dir(inner)


def removed(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that nothing reads any more; any other table is left alone."""
    for t in tables:
        if (path := _folders.pop(t, None)) is not None:
            for block in _scratch:
                block.discard(path)
            remove_folder(path)


#: Freed bytes that a process keeps, and the bytes from which an array is mapped apart and given back at once.
HEAP_KEPT, MAPPED_FROM = 64 << 20, 8 << 20


@functools.cache
def heap_kept() -> bool:
    """Lets this process keep a bounded heap of freed memory, where its libc has that setting; whether it does.

    Else glibc gives the end of the heap back as soon as arrays of some hundred KB are freed, and a loop
    over such arrays has its pages made anew in every turn.
    """
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError, TypeError):
        return False
    return all([mallopt(-3, MAPPED_FROM), mallopt(-1, HEAP_KEPT)])  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """A-Z as a-z; ``lower`` does it where no other letter has a lower case, many times faster than ``translate``."""
    return F.when(col.rlike(r"[[^\x00-\x7F]&&[\p{javaUpperCase}\p{javaTitleCase}\p{Cn}]]"), F.translate(col, UPPER, LOWER)).otherwise(F.lower(col))


def own_hash(col: Column) -> Column:
    """``col`` under an expression of its own, so that a join on it exchanges both sides and a hot key can be split at run time."""
    return F.concat(col, F.lit(""))
