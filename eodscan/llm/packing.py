"""Best-fit packing of tokenised documents into sequences of SEQUENCE tokens: best two fit.

Documents are tokenised in tasks; only (doc_id, piece, length, crc) travels on. Pieces of a whole
sequence are sequences already. The rest is dealt by a hash into groups of about GROUP pieces, and each
group is packed by itself: fill a bin greedily with the longest piece that fits, then take out its smallest
piece and look for two unpacked ones that fit the wider gap more tightly. A group leaves at most a few bins
unfilled, so the loss does not grow with the corpus, and no task holds more than a group.

Edge cases: null or empty text is the single id 0. A null doc_id is packed like any other. Repeated rows are
packed once each (their `copy` numbers differ inside a group only by place). Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEQUENCE = 2048
GROUP = 32_768
CACHE = 200_000  # words a worker remembers; twice as many between renewals


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SEPARATORS = "\x1c\x1d\x1e\x1f"  # white space to str.split, not to the tokenizer
LATIN_END = "\u0250"  # letters below it are whole under every normal form


class Known(dict):
    """A dict that learns what it lacks; `old` holds the entries before the last renewal."""

    def __init__(self, learn, old: dict | None = None):
        self.learn, self.old = learn, old or {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        ids = self[word] = self.learn(word) if ids is None else ids
        return ids

    def renewed(self) -> Known:
        if len(self) <= CACHE:
            return self
        self.old = {}  # before the new one fills up, so that two generations are held at most
        return Known(self.learn, self)


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds:
    """Ids of texts as little-endian bytes. White space only parts words in this vocabulary, so the ids of a
    text are those of its words in turn; words are tokenised once per worker while its memory lasts.

    A word of Latin letters with marks after it is one call of the vocabulary's model for the letters;
    all other words go through the whole tokenizer. Letters and marks are words themselves, so one memory
    holds all: it is what a worker's size depends on, as there are always new words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Known(self.learn)
        letters = [chr(i) for i in range(0x80, ord(LATIN_END)) if chr(i).isalpha()]
        self.spelled = {
            ord(c): "".join(part for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c)) for c in letters
        }

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if any(c in text for c in SEPARATORS):
            return [word for word in WHITE.split(text) if word]
        return text.split()

    def whole(self, word: str) -> bytes:
        return packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def learn_stem(self, stem: str) -> bytes:
        spelled = stem if stem.isascii() else stem.translate(self.spelled)
        return packed([token.id for token in self.tokenizer.model.tokenize(spelled)])

    def learn(self, word: str) -> bytes:
        lowered = word.lower()
        stem = lowered.rstrip(".,!?;:*#$%&")
        if not stem.isalpha() or not (stem.isascii() or max(stem) < LATIN_END):
            return self.whole(word)
        if stem != lowered:
            return self.known[stem] + self.known[lowered[len(stem) :]]
        return self.learn_stem(stem) if word == stem else self.known[stem]

    def of(self, texts: list[str | None]) -> Iterator[bytes]:
        for text in texts:
            self.known = self.known.renewed()
            yield b"".join(map(self.known.__getitem__, self.words(text))) + bytes(4)


def pieces(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    path = path or tokenizer_path()

    def cut(batches):
        coder = common.kept_by_worker(f"ids {path}", lambda: WordIds(path))
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for at in range(0, len(ids), 256):
                rows, piece, start, length, crc = [], [], [], [], []
                for row, coded in enumerate(coder.of(texts[at : at + 256].to_pylist()), at):
                    for nth, first in enumerate(range(0, len(coded), 4 * sequence)):
                        part = coded[first : first + 4 * sequence]
                        rows.append(row)
                        piece.append(nth)
                        start.append(first // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


class Lengths:
    """The unpacked pieces of a group by length, with the longest that fits a gap in O(1) (a bit set)."""

    def __init__(self, lengths: np.ndarray):
        self.left = np.bincount(lengths).tolist()
        self.bits = 0
        for n, count in enumerate(self.left):
            if count:
                self.bits |= 1 << n

    def longest(self, gap: int) -> int:
        """The largest length that is at most gap; 0 if there is none."""
        return max(0, (self.bits & ((2 << gap) - 1)).bit_length() - 1) if gap > 0 else 0

    def take(self, n: int) -> None:
        self.left[n] -= 1
        if not self.left[n]:
            self.bits &= ~(1 << n)

    def put(self, n: int) -> None:
        self.left[n] += 1
        self.bits |= 1 << n

    def best_two(self, gap: int) -> tuple[int, int]:
        """Two unpacked lengths with the largest sum that is at most gap; (0, 0) if there are none."""
        best, pair = 0, (0, 0)
        first = self.longest(gap - 1)
        while first and 2 * first > best:
            rest = gap - first
            second = self.longest(min(rest, first))
            if second == first and self.left[first] < 2:
                second = self.longest(first - 1)
            if second and first + second > best:
                best, pair = first + second, (first, second)
                if best == gap:
                    break
            first = self.longest(first - 1)
        return pair


def pack_lengths(lengths: np.ndarray, sequence: int = SEQUENCE) -> list[list[int]]:
    """Bins of lengths (each at least 1 and at most sequence)."""
    unpacked, bins = Lengths(lengths), []
    while unpacked.bits:
        content, gap = [], sequence
        while n := unpacked.longest(gap):
            unpacked.take(n)
            content.append(n)
            gap -= n
        while gap and unpacked.bits:
            smallest = content[-1]
            one, two = unpacked.best_two(gap + smallest)
            if one + two <= smallest:
                break
            unpacked.put(smallest)
            content.pop()
            for n in (one, two):
                unpacked.take(n)
                content.append(n)
            content.sort(reverse=True)
            gap += smallest - one - two
        bins.append(content)
    return bins


def place(lengths: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece."""
    order = np.argsort(lengths, kind="stable")
    first = np.searchsorted(lengths[order], np.arange(sequence + 2)).tolist()
    bin_of, offset_of = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for number, content in enumerate(pack_lengths(lengths, sequence)):
        at = 0
        for n in content:
            row = order[first[n]]
            first[n] += 1
            bin_of[row], offset_of[row] = number, at
            at += n
    return bin_of, offset_of


def pack(cut: DataFrame, sequence: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    # the row's number deals out equal rows as well, so no group is larger than the others
    cut = common.stored(cut.withColumn("llm_row", F.monotonically_increasing_id()), "pieces")
    whole = cut.filter(F.col("length") == sequence).drop("llm_row")
    part = cut.filter(F.col("length") < sequence)
    groups = max(1, -(-part.count() // group))  # ceil
    keyed = part.withColumn("llm_group", F.pmod(F.xxhash64("llm_row"), F.lit(groups)))

    def one_group(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable")
        number, offset = place(frame["length"].to_numpy(), sequence)
        # odd: packed bins; the group is in the number, so numbers never meet
        frame["sequence_id"] = (number * groups + frame["llm_group"].to_numpy()) * 2 + 1
        frame["offset"] = offset
        return frame.drop(columns=["llm_group", "llm_row"])

    packed = keyed.groupBy("llm_group").applyInPandas(one_group, f"{fields}, sequence_id long, offset long")
    alone = whole.select("*", (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: a row per piece of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(pieces(docs))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the packing of the documents that are left."""
    return pack(pieces(docs))
