"""Removal of long repeats: every byte covered by a SPAN-byte string that also starts earlier goes.

Equal strings are brought together by content. Of the SPAN - GRAM + 1 grams in a SPAN-byte string the one with the
smallest hash (rightmost of equals) is its anchor, so equal strings have equal anchors at the same place,
and every string belongs to one anchor. Consecutive strings of one anchor form a segment. Segments whose anchor
occurs once hold nothing repeated. Of equal segments all but the first are repeats as a whole, found by
aggregation and an equi-join, so any number of copies is cheap.

What is left are anchors with different segments. Strings of an anchor with more than MANY of them (the border of a
passage that many documents hold) are dealt out one by one, by the anchor's place in the string and content, and
all but the first of each are repeats; so no group grows with the corpus. The others are dealt out by anchor; a task takes the segments of
some anchors at a time, builds the Burrows-Wheeler transforms of two shards of them, and merges the
transforms: the interleave of the shards starts as one after the other and is refined by a stable partition on the
transformed symbols, which after k rounds has the suffixes of both shards sorted by k letters. Block borders
move along: where the first difference shows up in round k the common prefix is k - 1 letters. A letter
is LETTER bytes (its order is that of a hash; any order serves), so after SPAN / LETTER rounds the blocks are the
intervals of suffixes with SPAN bytes in common, and no suffix was sorted anew. In each block all but the
earliest are repeats.

Edge cases: null text is empty. A null doc_id precedes all others. Rows with the same doc_id and text are one
document: they get the same result. Different texts of one doc_id (null too) follow each other by a hash. Texts below SPAN bytes lose nothing. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPAN = 100
GRAM = 32
WINDOW = SPAN - GRAM + 1
LETTER = 10  # bytes; SPAN is a multiple
CHUNK_BYTES = 1 << 16  # of segments merged at once (one anchor's segments stay together): their letters have 16-bit ranks
MANY = (1 << 19) // (SPAN + WINDOW)  # segments of one anchor, beyond which its strings are dealt out one by one
NO_ID = -(1 << 63)

# ---------------------------------------------------------------- segments


def segments(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Segments of a block of texts: text, h (anchor), c (contents), pos (anchor's byte in its text), lo, hi (first and
    last start of its strings)."""
    n = len(data)
    none = np.zeros(0, dtype=np.int64)
    if n < SPAN:
        return {k: none for k in ("text", "h", "c", "pos", "lo", "hi")}
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(common.byte_values()[data] * common.powers(common.BASE, n), out=total[1:])
    inverse = common.powers(common.INVERSE, n + 1)
    grams = common.mix((total[GRAM:] - total[: n - GRAM + 1]) * inverse[: n - GRAM + 1])
    last = np.uint64(0xFFFFFFFF)
    least = (grams >> np.uint64(32) << np.uint64(32)) | (last - np.arange(len(grams), dtype=np.uint64))
    step = 1
    while 2 * step <= WINDOW:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if WINDOW > step:
        least = np.minimum(least[: len(least) - (WINDOW - step)], least[WINDOW - step :])
    anchor = (last - (least & last)).astype(np.int64)
    # strings that lie in one text
    size = np.diff(offsets)
    starts = np.zeros(n + 1, dtype=np.int32)
    long = size >= SPAN
    np.add.at(starts, offsets[:-1][long], 1)
    np.add.at(starts, offsets[1:][long] - SPAN + 1, -1)
    inside = np.flatnonzero(np.cumsum(starts[: len(anchor)]) > 0)
    if not len(inside):
        return {k: none for k in ("text", "h", "c", "pos", "lo", "hi")}
    own = anchor[inside]
    border = np.flatnonzero((np.diff(own) != 0) | (np.diff(inside) != 1)) + 1
    lo = inside[np.concatenate([[0], border])]
    hi = inside[np.concatenate([border - 1, [len(inside) - 1]])]
    pos = anchor[lo]
    text = np.searchsorted(offsets, lo, side="right") - 1
    shape = ((pos - lo).astype(np.uint64) << np.uint64(20)) + (hi - lo).astype(np.uint64)
    content = common.mix((total[hi + SPAN] - total[lo]) * inverse[lo] + common.mix(shape + np.uint64(1)))
    base = offsets[text]
    return {"text": text, "h": grams[pos].view(np.int64), "c": content.view(np.int64), "pos": pos - base, "lo": lo - base, "hi": hi - base}


# ---------------------------------------------------------------- merging shards


def dense(values: np.ndarray) -> np.ndarray:
    """Ranks from 1 of values, equal for equal values."""
    return np.unique(values, return_inverse=True)[1].astype(np.int64) + 1


def stable_order(symbols: np.ndarray) -> np.ndarray:
    """Stable argsort of symbols below 2 ** 32, by 16 bits at a time."""
    order = np.argsort(symbols.astype(np.uint16), kind="stable")
    if len(symbols) and symbols.max() >> 16:
        order = order[np.argsort((symbols[order] >> 16).astype(np.uint16), kind="stable")]
    return order


class Rotations:
    """All rotations of a shard's texts over an alphabet of LETTER-byte letters.

    A text gives LETTER strings of consecutive letters, one for each first byte below LETTER, each closed by an end
    symbol 0; so every byte of the text begins a rotation."""

    def __init__(self, symbols: np.ndarray, base: np.ndarray, size: np.ndarray):
        self.symbols, self.size = symbols, size
        self.base = np.repeat(base, size)  # of each rotation: where its string begins
        at = np.arange(len(symbols)) - self.base
        length = np.repeat(size, size)
        self.before = self.base + np.where(at == 0, length - 1, at - 1)
        self.order = self._sorted(at, length)
        self.transform = symbols[self.before[self.order]]  # the Burrows-Wheeler transform

    def _sorted(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Rotations in order, by prefix doubling; equal ones by place."""
        rank, step, longest = self.symbols.astype(np.int64), 1, int(self.size.max(initial=0))
        while step < longest:
            after = rank[self.base + (at + step) % length]
            rank = dense(rank * (int(rank.max(initial=0)) + 1) + after)
            step *= 2
        return np.argsort(rank, kind="stable")


def merged_blocks(one: np.ndarray, other: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """From two transforms: the interleave (False: one, True: other) and the block of each place, suffixes of a
    block having `rounds` letters in common."""
    from_other = np.zeros(len(one) + len(other), dtype=bool)
    from_other[len(one) :] = True
    block = np.zeros(len(from_other), dtype=np.int32)
    symbols = np.empty(len(from_other), dtype=np.uint32)
    for _ in range(rounds):
        symbols[~from_other] = one
        symbols[from_other] = other
        order = stable_order(symbols)
        symbols, from_other, block = symbols[order], from_other[order], block[order]
        border = (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1])
        block[0] = 0
        np.cumsum(border, out=block[1:])
    return from_other, block


def later_starts(texts: np.ndarray, begin: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Which SPAN-byte strings also start in an earlier text.

    texts: bytes one after the other; begin: where each begins, and the end; strings: how many strings (starts from 0) of
    each count. Texts are in the order of their documents. The result has an entry per start, text by text."""
    n, parts = len(begin) - 1, np.diff(begin)
    total = np.zeros(len(texts) + 1, dtype=np.uint64)
    np.cumsum(common.byte_values()[texts] * common.powers(common.BASE, len(texts)), out=total[1:])
    letters = np.zeros(len(texts), dtype=np.uint64)
    if len(texts) > LETTER:
        ends = len(texts) - LETTER + 1
        letters[:ends] = common.mix((total[LETTER:] - total[:ends]) * common.powers(common.INVERSE, ends))
    # strings of letters: text by text, first byte by first byte
    first = np.tile(np.arange(LETTER), n)
    size = np.maximum(0, (np.repeat(parts, LETTER) - first) // LETTER) + 1
    base = np.cumsum(size) - size
    at = np.arange(size.sum()) - np.repeat(base, size)
    place = np.repeat(np.repeat(begin[:-1], LETTER) + first, size) + at * LETTER  # byte at which a rotation begins
    closing = at == np.repeat(size, size) - 1
    symbols = np.zeros(len(at), dtype=np.uint32)
    symbols[~closing] = dense(letters[place[~closing]])
    half = n // 2 * LETTER
    cut = int(size[:half].sum())
    shards = [
        Rotations(symbols[:cut], base[:half], size[:half]),
        Rotations(symbols[cut:], base[half:] - cut, size[half:]),
    ]
    from_other, block = merged_blocks(shards[0].transform, shards[1].transform, SPAN // LETTER)
    rotation = np.empty(len(at), dtype=np.int64)
    rotation[~from_other] = shards[0].order
    rotation[from_other] = shards[1].order + cut
    # the starts asked for, in the order of the merged suffixes
    text = np.repeat(np.repeat(np.arange(n), LETTER), size)
    offset = place - begin[:-1][text]
    asked = (offset < strings[text])[rotation]
    rotation, block = rotation[asked], block[asked]
    owner = text[rotation]
    result = np.zeros(int(strings.sum()), dtype=bool)
    if len(rotation):
        heads = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        earliest = np.repeat(np.minimum.reduceat(owner, heads), np.diff(np.append(heads, len(block))))
        result[(np.cumsum(strings) - strings)[owner] + offset[rotation]] = owner > earliest
    return result


# ---------------------------------------------------------------- Spark


def scan(docs: DataFrame) -> DataFrame:
    """h, c, doc, at of each segment (doc, text); at packs the anchor's place, the reach before and after it, and
    whether an equal segment stands earlier in the text."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for first, _, data, offsets in common.blocks(batch.column("text")):
                found = segments(data, offsets)
                if not len(found["h"]):
                    continue
                order = np.lexsort((found["pos"], found["c"], found["h"], found["text"]))
                text, h, c, pos, lo, hi = (found[k][order] for k in ("text", "h", "c", "pos", "lo", "hi"))
                again = np.zeros(len(h), dtype=np.int64)
                again[1:] = (text[1:] == text[:-1]) & (h[1:] == h[:-1]) & (c[1:] == c[:-1])
                at = (((pos << 8 | (pos - lo)) << 8 | (hi - lo)) << 1) | again
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(c), pa.array(ids[first + text]), pa.array(at)], names=["h", "c", "doc", "at"]
                )

    return docs.select("doc", "text").mapInArrow(run, "h long, c long, doc long, at long")


def _low(at="at"):
    return F.shiftright(at, 17) - F.shiftright(at, 9).bitwiseAND(255)


def _high(at="at"):
    return _low(at) + F.shiftright(at, 1).bitwiseAND(255)


def repeats(docs: DataFrame) -> DataFrame:
    """doc, lo, hi: runs of starts of strings (first and last) that also start earlier. docs: (doc, text)."""
    anchors = scan(docs)
    common_ = anchors.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    seen = common.stored(anchors.join(common_.hint("shuffle_hash"), "h", "left_semi"), "segments")
    firsts = seen.groupBy("h", "c").agg(F.min("doc").alias("first"))
    placed = common.stored(seen.join(firsts, ["h", "c"]), "placed")
    again = F.col("at").bitwiseAND(1) == 1
    copies = placed.filter(again | (F.col("doc") > F.col("first"))).select("doc", _low().alias("lo"), _high().alias("hi"))
    different = firsts.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    different = common.stored(different, "different")
    open_ = placed.filter(~again & (F.col("doc") == F.col("first")))
    few, many = different.filter(F.col("n") <= MANY).select("h"), different.filter(F.col("n") > MANY).select("h")
    found = copies.unionByName(merge(pieces(docs, open_.join(few, "h", "left_semi").select("h", "doc", "at").distinct())))
    if many.isEmpty():
        return found
    return found.unionByName(by_string(pieces(docs, open_.join(many, "h", "left_semi").select("h", "doc", "at").distinct())))


def by_string(cut: DataFrame) -> DataFrame:
    """doc, lo, hi for pieces of anchors with many contents. Equal strings have equal anchors at the same place, so the
    strings are dealt out by anchor, place of the anchor and content, and no group is held in memory."""
    reach = F.shiftright("at", 1).bitwiseAND(255).cast("int")
    each = cut.select("h", "doc", "at", "bytes", F.explode(F.sequence(F.lit(0), reach)).alias("i"))
    strings = each.select(
        "h",
        (F.shiftright("at", 9).bitwiseAND(255) - F.col("i")).cast("short").alias("before"),
        F.xxhash64(F.expr(f"substring(bytes, i + 1, {SPAN})")).alias("s"),
        F.struct("doc", (_low() + F.col("i")).alias("start")).alias("place"),
    )
    strings = common.stored(strings, "strings")
    key = ["h", "before", "s"]
    firsts = strings.groupBy(*key).agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = strings.join(firsts, key).filter(F.col("place") > F.col("first"))
    return later.select("place.doc", F.col("place.start").alias("lo"), F.col("place.start").alias("hi"))


def pieces(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """The segments (h, doc, at) with their bytes."""
    wanted = open_.groupBy("doc").agg(F.collect_list(F.struct("h", "at")).alias("wanted"))
    texts = docs.join(wanted.hint("merge"), "doc")

    def cut(batches):
        last = None
        for batch in batches:
            rows = [[] for _ in range(4)]
            for doc, text, own in zip(*(batch.column(k) for k in ("doc", "text", "wanted"))):
                data, doc = text.as_buffer(), doc.as_py()
                if doc == last:
                    continue  # a repeated row
                last = doc
                data = memoryview(data) if data is not None else memoryview(b"")
                for one in own.as_py():
                    pos, before, reach = one["at"] >> 17, one["at"] >> 9 & 255, one["at"] >> 1 & 255
                    lo = pos - before
                    for column, value in zip(rows, (one["h"], doc, one["at"], bytes(data[lo : lo + reach + SPAN]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in rows[:3]), pa.array(rows[3], pa.binary())], names=["h", "doc", "at", "bytes"]
            )

    return texts.select("doc", F.col("text").cast("binary").alias("text"), "wanted").mapInArrow(
        cut, "h long, doc long, at long, bytes binary"
    )


def chunks(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows (h, doc, at, bytes) in order of h, about CHUNK_BYTES at a time; those of one h stay together.

    What a merge costs a byte grows with the chunk: it sorts, and its arrays are many times as large."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        if weight > CHUNK_BYTES and row[0] != held[-1][0]:
            yield held
            held, weight = [], 0
        held.append(row)
        weight += len(row[3])
    if held:
        yield held


def merge(cut: DataFrame) -> DataFrame:
    """doc, lo, hi for pieces whose contents differ."""

    def resolve(batches):
        columns = ("h", "doc", "at", "bytes")
        for held in chunks(row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in columns))):
            yield resolved(held)

    def resolved(held):
        held = list({row[:3]: row for row in held}.values())  # repeated rows may lie in several tasks
        held.sort(key=lambda row: (row[1], row[2] >> 17))
        strings = np.array([(row[2] >> 1 & 255) + 1 for row in held], dtype=np.int64)
        begin = np.cumsum([0, *(len(row[3]) for row in held)])
        later = later_starts(np.frombuffer(b"".join(row[3] for row in held), dtype=np.uint8), begin, strings)
        docs_, lows, highs = [], [], []
        borders = np.flatnonzero(np.diff(np.concatenate([[0], later.view(np.int8), [0]])))
        tops = np.cumsum(strings)
        for a, b in zip(borders[::2].tolist(), borders[1::2].tolist()):
            while a < b:  # a run may go over several texts
                i = int(np.searchsorted(tops, a, side="right"))
                end = min(b, int(tops[i]))
                low = (held[i][2] >> 17) - (held[i][2] >> 9 & 255) - int(tops[i] - strings[i])
                docs_.append(held[i][1])
                lows.append(low + a)
                highs.append(low + end - 1)
                a = end
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs_, lows, highs)], names=["doc", "lo", "hi"])

    dealt = cut.repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(resolve, "doc long, lo long, hi long")


def numbered(docs: DataFrame) -> DataFrame:
    """doc, doc_id, text of every row; doc is one number for each document (doc_id and text), in their order.

    It is the doc_id, unless one stands with different texts: then all documents are numbered anew."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "doc_id", text.alias("text"))
    known = rows.select("doc", "doc_id", F.xxhash64("text").alias("th")).distinct()
    if known.groupBy("doc").count().filter("count > 1").isEmpty():
        return rows
    # ascending over the sorted partitions
    number = F.monotonically_increasing_id().alias("doc")
    order = [F.col("doc_id").cast("long").asc_nulls_first(), "th"]
    numbers = common.stored(known.orderBy(*order).select(F.col("doc_id").alias("own_id"), F.col("th").alias("own_th"), number), "numbers")
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("th") == F.col("own_th"))
    return rows.drop("doc").withColumn("th", F.xxhash64("text")).join(numbers, same).select("doc", "doc_id", "text")


def removed(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text) with kept_text (bytes) and the counts of the query."""
    keyed = numbered(docs)
    # not stored: this join and the one in merge() then share one exchange of the texts
    runs = repeats(keyed).groupBy("doc").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    joined = keyed.join(runs.hint("merge"), "doc", "left").select(
        "doc_id", F.col("text").cast("binary").alias("text"), "runs"
    )

    def cut(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for text, own in zip(batch.column("text"), batch.column("runs")):
                data = np.frombuffer(text.as_buffer() or b"", dtype=np.uint8)
                border = np.zeros(len(data) + 1, dtype=np.int32)
                if own.is_valid:
                    flat = own.values.flatten()
                    np.add.at(border, flat[0].to_numpy(), 1)
                    np.add.at(border, flat[1].to_numpy() + SPAN, -1)
                gone = np.cumsum(border[:-1]) > 0
                kept = data[~gone].tobytes()
                spans = int(gone[:1].sum() + (np.diff(gone.view(np.int8)) == 1).sum())
                for column, value in zip(out, (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(
        cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op2: counts and the hash of what is kept of every document."""
    return removed(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept_text")
