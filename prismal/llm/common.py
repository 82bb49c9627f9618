"""Shared folders, tables that cut lineage, and small column helpers."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a session on one machine (local[...]) may leave it unset; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="prismal-")
        spark.conf.set("spark.checkpoint.dir", found)
    if "://" not in found and not found.startswith("file:"):  # a path of the default file system
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return found.replace("file:/", "file:///", 1) if re.match("file:/[^/]", found) else found


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Folders of tables that were written inside scratch(), innermost last.
_held: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("held", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables that table() writes inside, at the end, but for those handed to the function that this gives: they pass to the scratch() around it, if any."""
    outer = _held.get()
    mine: list[str] = []
    kept: list[str] = []
    token = _held.set((*outer, mine))

    def keep(df: DataFrame) -> DataFrame:
        kept.extend(p for p in mine if df.inputFiles() and any(p.rsplit("/", 1)[1] in f for f in df.inputFiles()))
        return df

    try:
        yield keep
    finally:
        _held.reset(token)
        for p in mine:
            if p not in kept:
                delete(spark, p)
            elif outer:
                outer[-1].append(p)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: later steps survive lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    if _held.get():
        _held.get()[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a frame made by table()."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def few(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """A table (written, of flat columns) for the small side of a join: broadcast where its rows take `limit` bytes at most, else joined by its key."""
    fixed = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}
    width = 16
    for _, kind in df.dtypes:
        if kind not in fixed and not (kind.startswith("struct<") and all(x.split(":")[1] in fixed for x in kind[7:-1].split(","))):
            return df
        width += 8 * (1 + kind.count(":"))
    return F.broadcast(df) if df.count() * width <= limit else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind where df has such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(v) with v bound to value once, so that a higher-order body doesn't evaluate it again per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. The quick built-in serves texts that are ASCII throughout."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def give_back() -> None:
    """Hand what this process has freed back to the system, after a step that held much: on the driver, or in a worker that waits beside what comes next."""
    if sys.platform == "linux" and hasattr(c := ctypes.CDLL(None), "malloc_trim"):
        c.malloc_trim(0)
    pa.default_memory_pool().release_unused()
