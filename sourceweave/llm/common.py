"""Small helpers that the text operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch between the JVM and Python.
ARROW_BYTES = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words are runs of digits, a-z and everything beyond ASCII; each byte of UTF-8 tells its class.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD_REGEX = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A-Z lower-cased, nothing else changed.
LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def hash_words(text: bytes) -> list[bytes]:
    """Lower-cased words of one UTF-8 text."""
    return text.translate(WORD_TABLE).split()


def trim() -> None:
    """Gives memory that a worker no longer uses back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What a worker remembers between tasks, by what it is for.
_KEPT: dict[str, object] = {}


def claim(key: str, make: Callable[[], object]) -> object:
    """The worker's one object of this key, which later tasks of the same operator find again."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeps: str | None = None) -> DataFrame:
    """mapInArrow over batches that bytes bound (one row at least). A task begins by dropping what its worker remembers for other operators
    (all but what was claimed as keeps) and ends by giving memory back."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key in [k for k in _KEPT if k != keeps]:
            del _KEPT[key]
        try:
            yield from run(batches)
        finally:
            trim()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df.mapInArrow(held, schema)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with the bytes of all values (of strings: UTF-8), and len+1 offsets into it. Nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) else b"")
    col = col.cast(pa.large_string()).cast(pa.large_binary()) if pa.types.is_string(col.type) else col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def byte_parts(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about so many bytes of text, one row at least."""
    _, off = utf8(batch.column("text"))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each start, one after the other."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(np.asarray(starts, np.int64) - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(total)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names, or the session's own where a test or a local session has set it."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ckpt"))  # one machine, as in tests
        top = spark.sparkContext.getCheckpointDir()
    return top.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared checkpoint folder."""
    import uuid

    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads on from there, so that lost executors repeat nothing before it."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of the filter by which rows are told that surely have no partner in a join, in maps of 32,768.
FILTER_BITS = 1 << 24


def split_by(rows: DataFrame, key: Column, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that may have a partner in wanted (a column k of hashes like key), and those that surely have none.

    A bit for each hash, in 512 maps of 4 KB at most however many there are, so the maps are broadcast. Where nearly all bits are set,
    it tells less and costs as much.
    """
    bit = F.pmod(F.col("k"), F.lit(FILTER_BITS))
    maps = wanted.groupBy(F.bitmap_bucket_number(bit).alias("map_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits_"))
    own = F.pmod(key, F.lit(FILTER_BITS))
    names = rows.columns
    both = rows.withColumn("at_", F.bitmap_bit_position(own).cast("int")).withColumn("own_", F.bitmap_bucket_number(own)).join(F.broadcast(maps), F.col("own_") == F.col("map_"), "left")
    byte = F.conv(F.hex(F.expr("substring(bits_, at_ div 8 + 1, 1)")), 16, 10).cast("int")
    there = F.coalesce(F.expr("1").cast("int").bitwiseAND(F.call_function("shiftright", byte, F.col("at_") % 8)) == 1, F.lit(False))
    return both.where(there).select(*names), both.where(~there).select(*names)


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b) of 64-bit nodes, not null: node and component, its smallest node. Nodes without links are absent.

    Each round sends every node to its smallest neighbour and joins what met; the rounds, about as many as the logarithm of a component's
    width, are chained afterwards. Rows are summed before each exchange.
    """
    left, maps = links.select("a", "b").where("a <> b").distinct(), []
    while True:
        both = left.union(left.select("b", "a")).toDF("v", "u")
        step = stash(both.groupBy("v").agg(F.least("v", F.min("u")).alias("m")), "cc")
        if step.isEmpty():
            break
        maps.append(step)
        to = step.select(F.col("v").alias("a"), F.col("m").alias("ma"))
        left = left.join(to, "a").join(to.toDF("b", "mb"), "b").select(F.col("ma").alias("a"), F.col("mb").alias("b")).where("a <> b").distinct()
        left = stash(left, "cc")
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    out = maps[0].toDF("node", "component")
    for step in maps[1:]:
        out = out.join(step.toDF("component", "m"), "component", "left").select("node", F.coalesce("m", "component").alias("component"))
    return out
