"""Shared helpers: numbering, text views, vectorised words and hashes."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import Stored, grown

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that one round of array work handles; bounds a worker's memory.
CHUNK_BYTES = 1 << 19

# Odd numbers with well spread bits.
_MULT, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Words up to this many bytes are hashed and compared eight bytes at a time, all words at once.
LANE_BYTES = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(rows: DataFrame, by: str, order: list, kept: Stored, name: str = "rank", total: str | None = None) -> DataFrame:
    """Stores `rows` with 0, 1, 2 ... in `order` within each `by`, by a range sort: one value of
    `by` can have most rows, so no window spans it; only counts by partition are summed up. `total` names a
    column for the number of rows of each `by`."""
    rows = rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order)  # Spark joins small neighbouring partitions
    rows = kept.put(rows.select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_at")))
    stretch = rows.groupBy(by, "_pid").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stretch = stretch.select("*", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), *([F.sum("_n").over(Window.partitionBy(by)).alias(total)] if total else []))
    stretch = kept.put(stretch.drop("_n"))  # a row for each value and partition
    out = kept.put(rows.join(grown(stretch), [by, "_pid"]).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before")).drop("_pid", "_at", "_first", "_before"))
    kept.drop(rows, stretch)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() agrees on pure ASCII and is many times faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


# ---------------------------------------------------------------- array views of text


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (int64) of a string array, without a copy of the bytes unless there
    are nulls, which count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks_of(offsets: np.ndarray, size: int = CHUNK_BYTES):
    """Row ranges (first, past) of about `size` bytes; a longer text is alone in its range."""
    n, first = len(offsets) - 1, 0
    while first < n:
        past = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        past = min(n, max(past, first + 1))
        yield first, past
        first = past
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: workers live through many stages, and would keep
    the peak of each."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Words are runs of anything but ASCII white space.
SPACED = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of digits, a-z and non-ASCII characters.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; bytes of longer UTF-8 characters are over 0x7F and stay."""
    return np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)


def words_of(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word
    (with the total at the end)."""
    inside = np.append(kind[data], False)
    edge = np.zeros(len(inside), bool)
    edge[offsets] = True
    before = np.append(False, inside[:-1])
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as a number."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit fingerprints of the byte spans: eight bytes at a time go through `mix`, which no
    pattern of bytes undoes. Different seeds give independent fingerprints."""
    size, lanes = ends - starts, _lanes(data)
    h = mix(size.astype(np.uint64) * _STEP + np.uint64((seed + 1) * int(_MULT) & (1 << 64) - 1))
    live, done = np.flatnonzero(size > 0), 0
    while len(live):
        if done == LANE_BYTES:
            h[live] = [xxhash.xxh3_64_intdigest(data[s:e].tobytes(), seed) for s, e in zip(starts[live].tolist(), ends[live].tolist(), strict=True)]
            break
        rest = size[live] - done
        lane = lanes[starts[live] + done] & _FIRST_BYTES[np.minimum(rest, 8)]
        h[live] = mix((h[live] ^ lane) * _MULT)
        live, done = live[rest > 8], done + 8
    return h


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of `size` bytes from a_starts and from b_starts on are equal."""
    out = np.ones(len(size), bool)
    one, two = _lanes(a), _lanes(b)
    live, done = np.flatnonzero(size > 0), 0
    while len(live):
        s, t = a_starts[live] + done, b_starts[live] + done
        if done == LANE_BYTES:
            out[live] = [a[x : x + n].tobytes() == b[y : y + n].tobytes() for x, y, n in zip(s.tolist(), t.tolist(), (size[live] - done).tolist(), strict=True)]
            break
        rest = size[live] - done
        equal = (one[s] ^ two[t]) & _FIRST_BYTES[np.minimum(rest, 8)] == 0
        out[live[~equal]] = False
        live, done = live[equal & (rest > 8)], done + 8
    return out


def run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of runs of word fingerprints: each run is a stretch of 1, 2, 4 ...
    words for each bit of its length, and fingerprints of stretches come from their halves."""
    length, at = ends - starts, starts.copy()
    h = mix(length.astype(np.uint64) * _MULT + _STEP)
    most, width, level = int(length.max()) if len(length) else 0, 1, words
    while width <= most:
        take = np.flatnonzero(length & width)
        h[take] = mix(h[take] * _STEP ^ level[at[take]])
        at[take] += width
        if 2 * width <= most:
            level = mix(level[:-width] * _MULT ^ level[width:])
        width *= 2
    return h


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of the ranges [start, start + length), one range after another."""
    lengths = np.asarray(lengths, np.int64)
    past = np.cumsum(lengths)
    return np.arange(past[-1] if len(past) else 0) + np.repeat(np.asarray(starts, np.int64) - (past - lengths), lengths)


def packed(arrays: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from one flat array and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(arrays, kind))
