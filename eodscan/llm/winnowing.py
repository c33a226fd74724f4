"""Document fingerprints by winnowing.

Every run of GRAM code points has a rolling hash; of each WINDOW consecutive hashes the smallest is chosen, of equal
ones the rightmost; chosen hashes keep their position. Two texts that share GRAM + WINDOW - 1 code points share a
chosen hash. A fingerprint is written as `hash@position` (8 hex digits, code points from 0), by position,
comma-joined. A text with fewer than GRAM code points has one hash of the whole at 0; an empty one an empty
fingerprint. Likeness is the Jaccard similarity of the hash sets; of two empty fingerprints it is 1.

The query also needs each document's successor by doc_id. Documents are dealt into ranges of doc_id whose
bounds are ids that occur; the first document of each range is sent to the range before it as well, so every range
is walked by itself, as a sorted stream that holds two texts at a time.

Edge cases: null text is an empty one. Rows with a null doc_id stand outside the order: their successor is empty.
Rows with equal doc_id follow each other in a fixed order. The only document succeeds itself. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

GRAM = 12
WINDOW = 36
RANGE_ROWS = 1000
MAX_RANGES = 100_000

FIELDS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen 32-bit hashes and their positions, by position."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(points)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gram = min(gram, n)
    weighed = common.mix(points + np.uint64(1)) * common.powers(common.BASE, n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(weighed, out=total[1:])
    grams = n - gram + 1
    hashes = common.mix((total[gram:] - total[:grams]) * common.powers(common.INVERSE, n + 1)[:grams])
    # the smallest key has the smallest hash and, of these, the rightmost position
    last = np.uint64(0xFFFFFFFF)
    key = (hashes >> np.uint64(32) << np.uint64(32)) | (last - np.arange(grams, dtype=np.uint64))
    step, window = 1, min(window, grams)
    least = key
    while 2 * step <= window:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    rest = window - step
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    chosen = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return chosen >> np.uint64(32), (last - (chosen & last)).astype(np.int64)


def written(hashes: np.ndarray, positions: np.ndarray) -> str:
    return ",".join(map("%08x@%d".__mod__, zip(hashes.tolist(), positions.tolist())))


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    a, b = set(one.tolist()), set(other.tolist())
    return len(a & b) / len(a | b) if a or b else 1.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row: the operator by itself."""

    def run(batches):
        for batch in batches:
            prints = [written(*winnow(text or "")) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


def first_ids(ids: DataFrame, cuts: list[float]) -> list[int]:
    """The smallest id of each range between cuts that has one, in order. Cuts are doubles, which don't hold every long."""
    cuts = np.array(sorted({min(int(c), (1 << 63) - 1) for c in cuts}), dtype=np.int64)
    shared = common.share(ids.sparkSession, cuts)

    def smallest(batches):
        cuts = shared()
        for batch in batches:
            values = np.sort(np.asarray(batch.column("doc_id")))
            where, at = np.unique(np.searchsorted(cuts, values, side="right"), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(values[at])], names=["llm_range", "doc_id"])

    found = ids.mapInArrow(smallest, "llm_range int, doc_id long").groupBy("llm_range").agg(F.min("doc_id").alias("doc_id"))
    return sorted(r.doc_id for r in found.collect())


def with_successors(docs: DataFrame) -> DataFrame:
    """llm_range, llm_role, doc_id, packed (the compressed text). Roles: 0 a document of the range, 1 what follows its last one, 2 without an id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id").filter("doc_id is not null")
    rows, first = ids.agg(F.count("*"), F.min("doc_id")).first()
    ranges = max(1, min(MAX_RANGES, rows // RANGE_ROWS))
    cuts = ids.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    bounds = np.array(first_ids(ids, cuts)[1:], dtype=np.int64)
    shared = common.share(docs.sparkSession, (bounds, first))

    def deal(batches):
        bounds, first = shared()
        seen = TaskContext.get().partitionId()
        for batch in batches:
            ids = batch.column("doc_id")
            known = np.asarray(ids.is_valid())
            values = np.asarray(ids.fill_null(0)).astype(np.int64)
            where = np.searchsorted(bounds, values, side="right")
            # rows without an id need no order, so they are dealt out to all ranges in turn
            where = np.where(known, where, (seen + np.arange(len(values))) % (len(bounds) + 1))
            seen += len(values)
            heads = np.flatnonzero(known & ((values == first) | np.isin(values, bounds)))
            before = (where[heads] - 1) % (len(bounds) + 1)
            rows = np.concatenate([np.arange(len(values)), heads])
            role = np.concatenate([np.where(known, 0, 2), np.ones(len(heads), np.int64)])
            texts = batch.column("text").take(pa.array(rows))
            packed = [zlib.compress(text.as_buffer() or b"", 1) for text in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([where, before]), pa.int32()),
                    pa.array(role, pa.int32()),
                    ids.take(pa.array(rows)),
                    pa.array(packed, pa.binary()),
                ],
                names=["llm_range", "llm_role", "doc_id", "packed"],
            )

    return docs.mapInArrow(deal, "llm_range int, llm_role int, doc_id long, packed binary")


def successors(docs: DataFrame) -> DataFrame:
    """The FIELDS of every document."""

    def walk(batches):
        held = None  # (range, id, text, hashes, positions) of the document whose successor is not yet known
        out: list[tuple] = []
        weight = 0

        def finish(follower: str, prints: np.ndarray) -> int:
            _, doc_id, text, hashes, positions = held
            cut = len(text) // 4
            edited = text[: len(text) - cut] + follower[:cut]
            edited_hashes, edited_positions = winnow(edited)
            out.append((
                doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                written(hashes, positions), written(edited_hashes, edited_positions),
                likeness(hashes, edited_hashes), likeness(hashes, prints),
            ))
            return len(text)

        def flushed():
            columns = [list(c) for c in zip(*out)] if out else [[]] * len(FIELDS)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=FIELDS)

        for batch in batches:
            for part, role, doc_id, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if role == 1 and (held is None or held[0] != part):
                    continue  # a second row of the following id
                if held is not None and held[0] != part:
                    raise RuntimeError(f"document {held[1]} has no successor in its range")
                text = zlib.decompress(packed).decode()
                hashes, positions = winnow(text)
                if role == 2:
                    held = (None, doc_id, text, hashes, positions)
                    weight += finish("", np.zeros(0, np.uint64))
                    held = None
                else:
                    if held is not None:
                        weight += finish(text, hashes)
                    held = None if role == 1 else (part, doc_id, text, hashes, positions)
                if weight > 1 << 22:
                    yield flushed()
                    weight = 0
        if held is not None:
            raise RuntimeError(f"document {held[1]} has no successor in its range")
        if out:
            yield flushed()

    dealt = with_successors(docs).repartition("llm_range").sortWithinPartitions("llm_range", "llm_role", "doc_id", "packed")
    return dealt.mapInArrow(
        walk,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op9: fingerprints of every document and of its edited text."""
    return successors(common.table(spark, sf_dir, "documents"))
