"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

For every benchmark item, each window of as many words as the item has is a candidate passage. A window whose
weighted 5-word-shingle similarity to the item reaches the threshold shares a shingle with it, so only windows that
hold a shingle of the item are fingerprinted; no other window can match. A window's 64-bit SimHash is
looked up in BLOCKS tables of 64 / BLOCKS bits: two fingerprints within RADIUS differ by at most
RADIUS // BLOCKS bits in one block, so probing each table with that tolerance finds every item within
RADIUS. Candidates are verified by weighted Jaccard similarity (weight: how often a shingle occurs).
RADIUS leaves four standard deviations above the mean distance of a pair at the threshold.

The items are a query set: they are read in blocks of ITEMS_PER_BLOCK, and each block's index (of a fixed greatest size)
is broadcast and held against all documents.

Edge cases: null or empty texts and items without words match nothing; items of fewer than 5 words are one
shingle of their length. Repeated items each match; repeated rows each give their rows. A null doc_id or item_id
is carried through. An empty benchmark gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

WORDS = 5
THRESHOLD = 0.75
RADIUS = 23
BLOCKS = 8
ITEMS_PER_BLOCK = 4096
FILTER_LOG2 = 20

BITS = 64 // BLOCKS


def bit_signs(hashes: np.ndarray) -> np.ndarray:
    """[n, 64] of -1 and 1."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each row of summed signs; a tie is a 0."""
    return np.packbits(sums > 0, axis=-1, bitorder="little").view("<u8").reshape(sums.shape[:-1])


def near_blocks() -> np.ndarray:
    """[2 ** BITS, 2 ** BITS]: whether two block values differ by at most RADIUS // BLOCKS bits."""
    values = np.arange(1 << BITS, dtype=np.uint64)
    return np.bitwise_count(values[:, None] ^ values[None, :]) <= RADIUS // BLOCKS


class Index:
    """Items of one block; `families` are the items of one length in words."""

    def __init__(self, items: list[tuple]):
        self.families: dict[int, dict] = {}
        by_length: dict[int, list] = {}
        for item_id, text in items:
            data = np.frombuffer((text or "").encode(), dtype=np.uint8)
            words, _ = common.word_table(data, np.array([0, len(data)])) if len(data) else (np.zeros(0, np.uint64), 0)
            if len(words):
                by_length.setdefault(len(words), []).append((item_id, words))
        near = near_blocks()
        shift = np.arange(BLOCKS, dtype=np.uint64) * np.uint64(BITS)
        for length, own in by_length.items():
            k = min(WORDS, length)
            runs = [common.combine(words, k) for _, words in own]
            prints = np.array([fingerprint(bit_signs(r).sum(axis=0)[None])[0] for r in runs], dtype=np.uint64)
            parts = (prints[:, None] >> shift) & np.uint64((1 << BITS) - 1)  # [item, block]
            owners = np.repeat(np.arange(len(own)), [len(r) for r in runs])
            hashes = np.concatenate(runs)
            order = np.argsort(hashes, kind="stable")
            self.families[length] = {
                "k": k,
                "ids": [item_id for item_id, _ in own],
                "prints": prints,
                # tables[block][value][item]
                "tables": np.stack([near[:, parts[:, b].astype(np.int64)] for b in range(BLOCKS)]),
                "counts": [np.unique(r, return_counts=True) for r in runs],
                "hashes": hashes[order],
                "owners": owners[order],
            }
        # by shingle size: a bit table to pass over most of a text, the hashes, and for each hash its families
        self.filters: dict[int, tuple] = {}
        for k in {family["k"] for family in self.families.values()}:
            own = {length: family["hashes"] for length, family in self.families.items() if family["k"] == k}
            hashes = np.unique(np.concatenate(list(own.values())))
            lengths: list[list[int]] = [[] for _ in hashes]
            for length, part in own.items():
                for at in np.searchsorted(hashes, np.unique(part)):
                    lengths[at].append(length)
            table = np.zeros(1 << FILTER_LOG2, dtype=bool)
            table[(hashes >> np.uint64(64 - FILTER_LOG2)).astype(np.int64)] = True
            self.filters[k] = table, hashes, lengths

    def search(self, runs: dict[int, np.ndarray], hits: dict[int, tuple]) -> Iterator[tuple]:
        """(item id, start, words, Hamming distance, similarity) of the best window of each matching item.

        runs[k]: this text's k-word hashes; hits[k]: positions of those that are an item's, and which they are."""
        near: dict[int, list[int]] = {}  # family: positions
        for k, (positions, which) in hits.items():
            lengths = self.filters[k][2]
            for position, one in zip(positions.tolist(), which.tolist()):
                for length in lengths[one]:
                    near.setdefault(length, []).append(position)
        for length, found in near.items():
            family = self.families[length]
            k = family["k"]
            own = runs[k]
            at = np.array(found)
            if len(own) < length - k + 1:
                continue
            span = length - k + 1  # shingles in a window
            last = len(own) - span
            mark = np.zeros(last + 2, dtype=np.int64)  # windows that hold a hit
            np.add.at(mark, np.clip(at - span + 1, 0, last + 1), 1)
            np.add.at(mark, np.minimum(at, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(mark)[: last + 1] > 0)
            yield from self._verify(family, own, starts, span, length)

    def _verify(self, family, own, starts, span, length):
        best: dict[int, tuple] = {}
        for a in range(0, len(starts), 4096):
            part = starts[a : a + 4096]
            lo, hi = int(part[0]), int(part[-1]) + span
            if hi - lo > 4 * len(part) + span:  # far apart: one by one region
                groups = np.split(part, np.flatnonzero(np.diff(part) > span) + 1)
            else:
                groups = [part]
            for group in groups:
                lo, hi = int(group[0]), int(group[-1]) + span
                total = np.zeros((hi - lo + 1, 64), dtype=np.int32)
                np.cumsum(bit_signs(own[lo:hi]), axis=0, out=total[1:])
                prints = fingerprint(total[group - lo + span] - total[group - lo])
                candidate = np.zeros((len(group), len(family["ids"])), dtype=bool)
                for b in range(BLOCKS):
                    value = ((prints >> np.uint64(b * BITS)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
                    candidate |= family["tables"][b][value]
                for w, i in zip(*np.nonzero(candidate)):
                    distance = int(np.bitwise_count(prints[w] ^ family["prints"][i]))
                    if distance > RADIUS:
                        continue
                    start = int(group[w])
                    score = similarity(family["counts"][i], own[start : start + span])
                    if score >= THRESHOLD and (i not in best or (-score, start) < best[i][:2]):
                        best[i] = (-score, start, distance)
        for i, (score, start, distance) in sorted(best.items()):
            yield family["ids"][i], start, length, distance, -score


def similarity(item: tuple[np.ndarray, np.ndarray], window: np.ndarray) -> float:
    """Weighted Jaccard of two multisets of shingles."""
    hashes, counts = np.unique(window, return_counts=True)
    _, mine, other = np.intersect1d(item[0], hashes, assume_unique=True, return_indices=True)
    both = np.minimum(item[1][mine], counts[other]).sum()
    return float(both / (item[1].sum() + counts.sum() - both))


def matches_in(column: pa.Array, index: Index) -> Iterator[tuple]:
    """(row, item id, start, words, distance, similarity) of a column of texts."""
    for first, last, data, offsets in common.blocks(column):
        words, bounds = common.word_table(data, offsets)
        runs, found = {}, {}
        rows_with_hits: set[int] = set()
        for k, (table, hashes, _) in index.filters.items():
            runs[k] = common.combine(words, k)
            at = np.flatnonzero(table[(runs[k] >> np.uint64(64 - FILTER_LOG2)).astype(np.int64)])
            which = np.minimum(np.searchsorted(hashes, runs[k][at]), len(hashes) - 1)
            same = hashes[which] == runs[k][at]
            at, which = at[same], which[same]
            row = np.searchsorted(bounds, at, side="right") - 1
            inside = at + k <= bounds[row + 1]
            found[k] = at[inside], which[inside], row[inside]
            rows_with_hits.update(found[k][2].tolist())
        for row in sorted(rows_with_hits):
            a, b = int(bounds[row]), int(bounds[row + 1])
            own_runs = {k: runs[k][a : max(a, b - k + 1)] for k in runs}
            hits = {k: (at[rows == row] - a, which[rows == row]) for k, (at, which, rows) in found.items()}
            for match in index.search(own_runs, hits):
                yield first + row, *match


def indexes(benchmark: DataFrame) -> Iterator:
    """Broadcast indexes of the items, block by block."""
    spark = benchmark.sparkSession
    block = []
    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        if len(block) == ITEMS_PER_BLOCK:
            yield common.share(spark, Index(block))
            block = []
    yield common.share(spark, Index(block))


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, n_words, hamming, similarity of every match."""
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, start_word long, n_words long, hamming int, similarity double"
    item_type = pa.string() if item_kind == "string" else pa.int64() if item_kind == "bigint" else pa.int32()

    def searcher(shared):
        def run(batches):
            index = shared()
            for batch in batches:
                rows = list(matches_in(batch.column("text"), index))
                row, item, start, n, hamming, score = zip(*rows) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(row, pa.int32())),
                        pa.array(item, item_type),
                        pa.array(start, pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array(hamming, pa.int32()),
                        pa.array(score, pa.float64()),
                    ],
                    names=["doc_id", "item_id", "start_word", "n_words", "hamming", "similarity"],
                )

        return run

    result = None
    for shared in indexes(benchmark):
        part = docs.select("doc_id", "text").mapInArrow(searcher(shared), schema)
        result = part if result is None else result.unionByName(part)
    return result


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every match of a benchmark item in a document."""
    return find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents that hold a benchmark item go."""

    def keeper(shared):
        def run(batches):
            index = shared()
            for batch in batches:
                dirty = {row for row, *_ in matches_in(batch.column("text"), index)}
                yield batch.filter(pa.array([row not in dirty for row in range(batch.num_rows)], pa.bool_()))

        return run

    kept = docs
    for shared in indexes(common.table(spark, sf_dir, "benchmark")):
        kept = kept.mapInArrow(keeper(shared), docs.schema)
    return kept
