"""What the operators share: tables, written intermediate results, texts as flat byte arrays, hashes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelake.session import shared_folder, small_batches  # noqa: F401

# ---------------------------------------------------------------- tables and written results


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WRITTEN: dict[str, list[str]] = {}


def saved(df: DataFrame, until_end: bool = False) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends here.

    A lost executor costs a read of these files, not a run of what made them.  The files
    go with ``release``, or when the session ends if ``until_end``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not until_end:
        _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what ``saved`` has written so far; for callers that have stored their results."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def written_so_far(spark: SparkSession) -> int:
    """How many tables ``saved`` has that ``release`` would delete."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def release_inner(spark: SparkSession, first: int) -> None:
    """Delete what ``saved`` has written from the table number ``first`` on, other than the last."""
    paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
    for path in paths[first:-1]:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    paths[first:-1] = []


def text_key(text: Column) -> Column:
    """A 128-bit name of a text as two longs; null counts as the empty text."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- texts as flat byte arrays

_LIBC = ctypes.CDLL(None)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about ``max_bytes`` together; a longer text is a run of its own."""
    texts = batch.column(column)
    if not len(texts):
        return
    sizes = np.asarray(pc.binary_length(texts.fill_null("")), dtype=np.int64)
    bounds = np.flatnonzero(np.diff(np.cumsum(sizes) // max_bytes, prepend=-1))
    for a, b in zip(bounds, [*bounds[1:], len(sizes)], strict=True):
        yield batch.slice(a, b - a)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one uint8 array, and the offsets where each starts, with the end; null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


#: The bytes \x20 and \x09-\x0D part words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def segments(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the longest runs of bytes that are no breaks; none crosses texts."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~breaks[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | border[1:-1]
    end[:-1] &= ~inside[1:] | border[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, side="right") - 1


_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd number and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        for k, base in enumerate((int(_ODD), pow(int(_ODD), -1, 1 << 64))):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _POWERS[k] = np.cumprod(step)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: A running polynomial modulo 2**64 repeats itself on long regular strings, so it hashes blocks of so many bytes.
HASHED_BYTES = 32


def hash_segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: those of blocks, scrambled with their place and added up."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])

    def blocks(a, b):
        return mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))

    size = ends - starts
    out = blocks(starts, np.minimum(starts + HASHED_BYTES, ends))
    long = np.flatnonzero(size > HASHED_BYTES)
    if len(long):
        more = -(-size[long] // HASHED_BYTES) - 1
        first = np.cumsum(more) - more
        place = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        a = np.repeat(starts[long], more) + HASHED_BYTES * place
        h = blocks(a, np.minimum(a + HASHED_BYTES, np.repeat(ends[long], more)))
        rest = np.add.reduceat(mix(h ^ mix(place.astype(np.uint64) * _ODD)), first)
        out[long] = mix(out[long] + mix(rest) + size[long].astype(np.uint64))
    return out


def windows(hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` neighbouring words of one text, and their first word's number."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        h = mix(h + hashes[at + k] + np.uint64(k))
    return h, at


def spread(docs: np.ndarray, n: int) -> np.ndarray:
    """How often each text number 0..n-1 occurs."""
    return np.bincount(docs, minlength=n).astype(np.int64)


def trim() -> None:
    """Give freed memory back to the system: Python workers wait for later stages beside other tasks."""
    pa.default_memory_pool().release_unused()
    free = getattr(_LIBC, "malloc_trim", None)
    if free is not None:
        free(0)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def output(batch: pa.RecordBatch, keep: list[str], **columns) -> pa.RecordBatch:
    """The kept columns of a batch with new ones behind them."""
    fields = {c: batch.column(c) for c in keep} | {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays(list(fields.values()), names=list(fields))


def unclashed(df: DataFrame, names: list[str]) -> DataFrame:
    """Without the columns whose names the operator is about to add, whatever their case."""
    low = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def extended(df: DataFrame, more: str, without: tuple[str, ...] = ()) -> T.StructType:
    """The schema of a table, less some columns, with those of a DDL string behind it."""
    return T.StructType([f for f in df.schema.fields if f.name not in without] + T._parse_datatype_string(more).fields)


def apart(df: DataFrame, own: list[str]):
    """The table with neutral names for all columns but ``own``, and what gives a result its names back.

    Inner columns of an operator can't clash with the input's then; the result has the
    input's columns, as far as it still has them, and the new ones behind.
    """
    inner = {c: c if c in own else f"__column_{k}" for k, c in enumerate(df.columns)}

    def restored(out: DataFrame) -> DataFrame:
        held = [(c, n) for c, n in inner.items() if n in out.columns]
        new = [c for c in out.columns if c not in inner.values()]
        return out.select(*[F.col(n).alias(c) for c, n in held], *new)

    return df.select([F.col(f"`{c}`").alias(n) for c, n in inner.items()]), restored


# ---------------------------------------------------------------- a filter of fixed size for text keys

FILTER_BITS = 24


def key_filter(keys: DataFrame):
    """A broadcast bitmap of 2**24 bits over k1, whatever the number of keys: it says which texts may be among them.

    More keys make it let more through, never less; the join behind it decides.
    """
    place = F.col("k1").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bits = keys.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(k1 & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << FILTER_BITS - 6, np.int64)
    words[bits.column("word").to_numpy()] = bits.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(words)


def may_hold(words: np.ndarray, k1: np.ndarray) -> np.ndarray:
    place = k1 & ((1 << FILTER_BITS) - 1)
    return (words[place >> 6] >> (k1 & 63) & 1).astype(bool)


def filtered(keyed: DataFrame, shared, keep: bool = True, once: bool = False) -> DataFrame:
    """Rows whose key may be (or surely isn't) in the filter; ``once``: of equal keys in a task only the first."""
    def run(batches):
        seen = set()
        for batch in batches:
            k1 = batch.column("k1").to_numpy()
            take = may_hold(shared.value, k1) == keep
            if once:
                k2 = batch.column("k2").to_numpy()
                for k in np.flatnonzero(take):
                    key = (int(k1[k]), int(k2[k]))
                    take[k] = key not in seen
                    seen.add(key)
            yield batch.filter(pa.array(take))

    return keyed.mapInArrow(run, keyed.schema)
