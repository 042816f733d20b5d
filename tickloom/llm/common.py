"""What the text operators share: written stages, and Arrow passes over whole texts."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_FOLDER = "file:///tmp/checkpoints/tickloom"
#: Rows of a driver-made table that may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 20_000
#: Bytes of text whose results a Python task holds at a time.
PIECE = 2 << 20
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<array<bigint>>": pa.list_(pa.list_(pa.int64()))}


class _Open(threading.local):
    """Of each open block of swept() in this thread: the paths that go when it ends. Queries of other threads have their own."""

    def __init__(self) -> None:
        self.blocks: list[list[str]] = []


_open = _Open()


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all machines of the cluster share. Without one, a local folder on a local master; on
    a cluster that would lose rows without an error, so it is one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        base = LOCAL_FOLDER
    path = f"{base.rstrip('/')}/tickloom-{uuid.uuid4().hex}/{name}"
    if _open.blocks:
        _open.blocks[-1].append(path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: what follows doesn't recompute it, and a lost executor loses no part of it.
    The table goes with the block of swept() that it is written in; outside of all it stays."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def swept(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A block whose kept() tables go when it ends, also if it fails. It yields a kept() whose tables outlive it: for what the
    block has to hand on, since a frame that is read later needs its tables."""
    mine: list[str] = []
    _open.blocks.append(mine)

    def outliving(df: DataFrame, name: str) -> DataFrame:
        out = kept(df, name)
        path = mine.pop()
        if len(_open.blocks) > 1:
            _open.blocks[-2].append(path)
        return out

    try:
        yield outliving
    finally:
        _open.blocks.pop()
        for path in mine:
            at = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def row_of(docs: DataFrame) -> Column:
    """The whole row as one struct, so that no name of an extra column can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcasting if its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def words(text: bytes | None) -> list[bytes]:
    r"""The runs of [^\x20\x09-\x0D] in UTF-8 text; bytes.split() parts at these six bytes."""
    return text.split() if text else []


_held: dict[object, object] = {}
_asked: set[object] = set()


def held(key: object, make: Callable[[], object]) -> object:
    """make()'s value, kept in this Python worker for its later tasks, until begun() begins one that doesn't ask for it."""
    if key not in _held:
        _held[key] = make()
    _asked.add(key)
    return _held[key]


def begun(make: Callable[[], Callable]) -> Callable:
    """make(), and nothing held that it hasn't asked for: workers outlive their stage, and what they hold takes memory from the next."""
    _asked.clear()
    fn = make()
    for key in [k for k in _held if k not in _asked]:
        del _held[key]
    return fn


def per_text(rows: DataFrame, fields: str, make: Callable[[], Callable[..., tuple]], text: str = "text", also: str | None = None) -> DataFrame:
    """The other columns of rows, then `fields` ("name type, ..."), computed from the whole text of each row as UTF-8 (None for null).

    make() runs once in each task and gives the function; it gets the column `also` as well, if one is named. One text at
    a time is taken out of the Arrow batch, and results are handed on after each PIECE bytes of text.
    """
    names, kinds = zip(*(f.strip().split(" ", 1) for f in fields.split(", ")))
    rest = [f for f in rows.schema.fields if f.name not in (text, also)]
    added = T.StructType.fromDDL(fields.replace(", ", ","))
    types = [ARROW[k] for k in kinds]
    others, used = [f.name for f in rest], [text] if also is None else [text, also]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, n = begun(make), len(others)

        def piece(b: pa.RecordBatch, got: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), *(pa.array(c, t) for c, t in zip(zip(*got), types))], [*others, *names])

        for b in batches:
            start, size, got = 0, 0, []
            for k, xs in enumerate(zip(*(b.column(n + i) for i in range(len(used))))):
                values = [x.as_py() for x in xs]
                got.append(fn(*values))
                size += len(values[0] or b"")
                if size >= PIECE:
                    yield piece(b.slice(start, k + 1 - start), got)
                    start, size, got = k + 1, 0, []
            if got:
                yield piece(b.slice(start), got)

    asked = rows.select(*[F.col(f"`{c}`") for c in others], F.col(text).cast("binary").alias(text), *([] if also is None else [also]))
    return asked.mapInArrow(run, T.StructType([*rest, *added.fields]))
