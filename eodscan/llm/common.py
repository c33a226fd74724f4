"""Shared by the operators: reading tables, shared scratch space, hashing of words in numpy."""

from __future__ import annotations

import re
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 18  # texts worked on at once, so that arrays of 8 bytes a byte stay in cache; a longer text is a block of its own

WHITE = [0x20, *range(0x09, 0x0E)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir; below the warehouse if that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return f"{root.rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written to shared storage and read back: cuts lineage, survives lost executors.

    The shuffles of the write go with its end; else they stay on disk until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_IDS = 1_000_000  # 8 MB of ids; above it a shuffled join


def among(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """docs whose doc_id is (left_semi) or is not (left_anti) among ids (doc); ids must be stored.

    The ids are broadcast only if they were counted and are few: else the texts are shuffled."""
    ids = ids.select(F.col("doc").alias("llm_doc"))
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("llm_doc"), how)


def share(spark: SparkSession, value, views: bool = False) -> Callable:
    """Broadcasts a value of bounded size; tasks call the result once to get it. Classes travel by value.

    views: arrays are read-only views of what was broadcast, so that a worker holds them once."""
    arrays: list = []
    packed = cloudpickle.dumps(value, protocol=5, buffer_callback=arrays.append if views else None)
    shared = spark.sparkContext.broadcast((packed, [a.raw().tobytes() for a in arrays]))
    return lambda: cloudpickle.loads(shared.value[0], buffers=shared.value[1])


def kept_by_worker(name: str, make: Callable):
    """A value that a Python worker makes once for all its tasks; for caches only, never for results."""
    store = sys.modules.setdefault("llm_worker_store", types.ModuleType("llm_worker_store"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all else unchanged."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


# ---------------------------------------------------------------- numpy side


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length()) if n <= 4 * BLOCK_BYTES else n
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 4 * BLOCK_BYTES:
            _POWERS[base] = have
    return have[:n]


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of texts of about block_bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + block_bytes, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WHITE = np.zeros(256, dtype=bool)
IS_WHITE[WHITE] = True
IS_WORD = ~IS_WHITE


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run of word bytes inside one text."""
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of spans of the lower-cased (A-Z) bytes."""
    weighed = byte_values()[LOWER[data]] * powers(BASE, len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(weighed, out=total[1:])
    return mix((total[ends] - total[starts]) * powers(INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def combine(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(BASE) + words[j : j + n]
    return mix(out)


def word_table(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block of texts, and where each text's words begin (one entry more than texts)."""
    starts, ends = word_spans(data, offsets, is_word)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text; fewer than k words: one hash of the whole sequence."""
    for first, last, data, offsets in blocks(column):
        words, bounds = word_table(data, offsets)
        runs = combine(words, k)
        for row in range(first, last):
            a, b = bounds[row - first], bounds[row - first + 1]
            if b - a >= k:
                yield row, np.unique(runs[a : b - k + 1])
            elif b > a:
                yield row, combine(words[a:b], int(b - a))
            else:
                yield row, np.zeros(0, dtype=np.uint64)


def words_of(text: str | None) -> list[str]:
    """The same words in plain Python, for tests and small tables."""
    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)
