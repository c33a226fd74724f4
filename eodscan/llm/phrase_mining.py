"""Phrase collocation mining with double-array tries.

Words are counted first, per language; a word of fewer than MIN occurrences stands in no candidate. The frequent words
get numbers and a double-array trie over their bytes turns texts into runs of numbers: numpy takes the states of
all words of a block of text one byte further at a time, until all have ended or left the trie. These runs are stored
and read by all later passes.

Pass k holds the trie of the candidates of k - 1 words (its symbols are word numbers), takes the states of all positions
through its levels at once, and counts the accepting states by bincount. Where the candidates of two neighbouring
positions both stand, the k words they cover are a candidate of the next pass: all their parts are frequent, so no frequent
phrase is missed (Apriori). Tasks add such places up and shuffle them in packed blocks; those that stay below MIN are no candidates. (The
usual self join of the frequent phrases would pair everything before a frequent word with everything behind it.) The
tasks' counts are added up by Spark.

A double array: state s goes with symbol c to slot (base[s] + c) modulo the number of slots, if check of that slot is s.
The first level's states are the word numbers themselves and have no slots. A node's children take their slots all levels at
once, nodes with most children first, so that those still find room. Tries are built on the driver and broadcast up to TRIE_NODES
nodes (WORD_BYTES bytes of words), 18 bytes a node and more where many nodes have many
children; a worker holds them once. Beyond, words are numbered by a join, and phrases are counted by a shuffle.

Edge cases: null text is empty; null lang is `und`. Words of any length are whole. Repeated rows, and rows without an id,
count as often as they stand. Language values without a candidate don't come up; an empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN = 100  # occurrences of a candidate
LONGEST = 5
TOP = 2000  # of each language
WORD_BYTES = 32_000_000
TRIE_NODES = 4_000_000
SLICE = 1 << 18  # places of text worked on at once
HELD = 1 << 20  # distinct next candidates that a task holds before it gives them out; places a bucket

BREAKS = r"[.,;:!?\x0A-\x0D]"
BLANKS = r"[\x20\x09]+"
SEPARATORS = r"[\x20\x09.,;:!?\x0A-\x0D]+"

IS_BREAK = np.zeros(256, dtype=bool)
IS_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
IS_LETTER = ~IS_BREAK
IS_LETTER[[0x20, 0x09]] = False


# ---------------------------------------------------------------- double arrays


class Full(Exception):
    """No place for a node was found."""


class DoubleArray:
    """A trie whose first-level states are the symbols 0 .. symbols - 1, and index[s], the number of the entry of s."""

    def __init__(self, symbols: int, nodes: int):
        self.symbols, self.room = symbols, max(16, symbols, nodes + nodes // 2)
        self.size = symbols + self.room
        self.base = np.zeros(self.size, dtype=np.int32)
        self.check = np.full(self.size, -1, dtype=np.int32)
        self.index = np.full(self.size, -1, dtype=np.int32)
        self.check[:symbols] = -2  # the root's
        self._rng = np.random.default_rng(11)

    def add_level(self, parents: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states of new children, one of each distinct (parent, symbol); parents had no children before."""
        return self.add_levels([(parents, symbols)])[0]

    def add_levels(self, levels: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The same for several levels; from the second on, parents are places in the level before."""
        orders, begins, counts = [], [], []
        for parents, symbols in levels:
            order = np.lexsort((symbols, parents))
            first = np.flatnonzero(np.diff(parents[order], prepend=-1))
            orders.append(order)
            begins.append(first)
            counts.append(np.diff(np.append(first, len(order))))
        level = np.repeat(np.arange(len(levels)), [len(n) for n in counts])
        sorted_ = [symbols[order].astype(np.int64) for (_, symbols), order in zip(levels, orders)]
        begin, count = np.concatenate([[], *begins]).astype(np.int64), np.concatenate([[], *counts]).astype(np.int64)
        bases, taken = np.empty(len(level), dtype=np.int64), self.check[self.symbols :] != -1
        for nth in np.argsort(-count, kind="stable"):
            if count[nth] == 1:
                break
            bases[nth] = self._placed(sorted_[level[nth]][begin[nth] : begin[nth] + count[nth]], taken)
        single = np.flatnonzero(count == 1)  # these fit anywhere
        free = np.flatnonzero(~taken)[: len(single)]
        if len(free) < len(single):
            raise Full
        only = np.concatenate([[], *(own[first[n == 1]] for own, first, n in zip(sorted_, begins, counts))]).astype(np.int64)
        bases[single] = (free - only) % self.room
        states, done = [], 0
        for (parents, _), order, own, first, n in zip(levels, orders, sorted_, begins, counts):
            base, done = bases[done : done + len(n)], done + len(n)
            above = parents[order] if not states else states[-1][parents[order]]
            slots = (np.repeat(base, n) + own) % self.room + self.symbols
            self.base[above[first]] = base
            self.check[slots] = above
            states.append(np.empty(len(order), dtype=np.int64))
            states[-1][order] = slots
        return states

    def _placed(self, symbols: np.ndarray, taken: np.ndarray) -> int:
        for _ in range(64):
            tries = self._rng.integers(0, self.room, 32)
            at = (tries[:, None] + symbols[None]) % self.room
            good = np.flatnonzero(~taken[at].any(axis=1))
            if len(good):
                taken[at[good[0]]] = True
                return int(tries[good[0]])
        raise Full

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Next states; -1 where there is none, or where state or symbol is negative."""
        at = self.base[states].astype(np.int64) + symbols
        at += self.symbols - self.room * (at >= self.room)
        return np.where((states >= 0) & (symbols >= 0) & (self.check[at] == states), at, -1)


def built(symbols: int, nodes: int, fill) -> DoubleArray:
    """A trie that fill() filled; with half as many slots more as often as it takes."""
    while True:
        trie = DoubleArray(symbols, nodes)
        try:
            fill(trie)
            return trie
        except Full:
            nodes = trie.room


def word_trie(words: list[tuple[int, bytes]], ids: list[int], languages: int) -> DoubleArray:
    """Over a word's language number, then its bytes; index gives its id."""
    letters = 256
    data = np.frombuffer(b"".join(w for _, w in words), dtype=np.uint8)
    sizes = np.array([len(w) for _, w in words], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    at, levels = np.array([lang for lang, _ in words], dtype=np.int64), []
    for depth in range(sizes.max(initial=0)):
        still = np.flatnonzero(sizes > depth)
        both, at[still] = np.unique(at[still] * letters + data[begins[still] + depth], return_inverse=True)
        levels.append((both // letters, both % letters))

    def fill(trie):
        for depth, states in enumerate(trie.add_levels(levels)):
            whole = np.flatnonzero(sizes == depth + 1)
            trie.index[states[at[whole]]] = np.asarray(ids)[whole]

    return built(max(letters, languages), sum(len(parents) for parents, _ in levels), fill)


# ---------------------------------------------------------------- words


def languages(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("text is not null")


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f of the words of MIN occurrences and more; and a row with a null word: the occurrences of all others."""
    words = F.split(common.lower_ascii(F.col("text")), SEPARATORS, -1)
    each = docs.select("lang", F.explode(words).alias("word")).filter("word <> ''")
    counted = each.groupBy("lang", "word").agg(F.count("*").alias("c"))
    return counted.groupBy("lang", F.when(F.col("c") >= MIN, F.col("word")).alias("word")).agg(F.sum("c").alias("f"))


def numbered(df: DataFrame, name: str, label: str) -> DataFrame:
    """Stored rows with dense numbers from 0: a number inside each part, and the rows of the parts before it."""
    inside = common.stored(df.withColumn("llm_at", F.monotonically_increasing_id()), label)
    part = F.shiftright("llm_at", 33)
    before = Window.orderBy("llm_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = inside.groupBy(part.alias("llm_part")).agg(F.count("*").alias("llm_c"))  # a row for each part
    starts = sizes.select("llm_part", F.coalesce(F.sum("llm_c").over(before), F.lit(0)).alias("llm_start"))
    placed = inside.withColumn("llm_part", part).join(F.broadcast(starts), "llm_part")
    number = F.col("llm_start") + F.col("llm_at").bitwiseAND(F.lit((1 << 33) - 1))
    return common.stored(placed.select(number.cast("int").alias(name), *df.columns), label)


def encode(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Stored runs of word numbers (ids): all places where two frequent words or more stand in a row; -1 parts runs."""
    size = vocabulary.agg(F.sum(F.octet_length("word") + 1)).first()[0] or 0
    runs = _by_trie(docs, vocabulary) if size <= WORD_BYTES else _by_join(docs, vocabulary)
    return common.stored(runs, "runs")


def _by_trie(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    known = vocabulary.select("id", "lang", F.col("word").cast("binary").alias("word")).toArrow()  # at most WORD_BYTES of words
    langs = known.column("lang").to_pylist()
    names = {name: nth for nth, name in enumerate(sorted(set(langs)))}
    trie = word_trie([(names[lang], word) for lang, word in zip(langs, known.column("word").to_pylist())], known.column("id").to_numpy(), len(names))
    shared = common.share(docs.sparkSession, (trie, names), views=True)

    def run(batches):
        trie, names = shared()
        for batch in batches:
            of_row = np.array([names.get(x, -1) for x in batch.column("lang").to_pylist()], dtype=np.int64)
            for first, last, data, offsets in common.blocks(batch.column("text")):
                ids = word_numbers(trie, of_row[first:last], data, offsets)
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))], names=["ids"])

    return docs.select("lang", "text").mapInArrow(run, "ids array<int>")


def word_numbers(trie: DoubleArray, of_row: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Runs of two or more frequent words of a block of texts, each followed by -1."""
    data = common.LOWER[data]
    starts, ends = common.word_spans(data, offsets, IS_LETTER)
    text = np.searchsorted(offsets, starts, side="right") - 1
    state, alive, depth = of_row[text], np.flatnonzero(of_row[text] >= 0), 0
    ids = np.full(len(starts), -1, dtype=np.int32)
    while len(alive):
        ended = starts[alive] + depth == ends[alive]
        ids[alive[ended]] = trie.index[state[alive[ended]]]
        alive = alive[~ended]
        state[alive] = trie.step(state[alive], data[starts[alive] + depth].astype(np.int64))
        alive = alive[state[alive] >= 0]
        depth += 1
    breaks = np.concatenate([[0], np.cumsum(IS_BREAK[data])])
    follows = (breaks[starts[1:]] == breaks[ends[:-1]]) & (text[1:] == text[:-1]) & (ids[1:] >= 0) & (ids[:-1] >= 0)
    after, before = np.append(follows, False), np.insert(follows, 0, False)[: len(ids)]
    kept = after | before if len(ids) else np.zeros(0, dtype=bool)
    ids, last = ids[kept], ~after[: len(kept)][kept]
    out = np.full(len(ids) + int(last.sum()), -1, dtype=np.int32)
    out[np.arange(len(ids)) + np.cumsum(last) - last] = ids
    return out


def _by_join(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The same runs, a row a piece, when the words are too many for a trie."""
    lowered = docs.select("lang", F.posexplode(F.split(common.lower_ascii(F.col("text")), BREAKS, -1)).alias("p", "piece"))
    pieces = common.stored(lowered.select(F.monotonically_increasing_id().alias("at"), "lang", "piece"), "pieces")
    words = pieces.select("at", "lang", F.posexplode(F.filter(F.split("piece", BLANKS, -1), lambda w: w != "")).alias("nth", "word"))
    known = words.join(vocabulary.select("lang", "word", "id"), ["lang", "word"], "left")
    row = F.array_sort(F.collect_list(F.struct("nth", F.coalesce("id", F.lit(-1)).cast("int").alias("id"))))
    return known.groupBy("at").agg(row.alias("row")).select(F.col("row.id").alias("ids")).filter("size(ids) > 1")


# ---------------------------------------------------------------- phrases


def run_slices(batches) -> Iterator[np.ndarray]:
    """The runs of several rows, or a part of a long row, of about SLICE places; -1 stands between runs."""
    for batch in batches:
        column = batch.column("ids")
        sizes = column.value_lengths().to_numpy().astype(np.int64)
        values, ends = column.flatten().to_numpy(), np.cumsum(sizes)
        first = 0
        while first < len(sizes):
            begin = ends[first] - sizes[first]
            last = max(first + 1, int(np.searchsorted(ends, begin + SLICE, side="right")))
            own = sizes[first:last]
            ids = np.full(int(own.sum()) + len(own), -1, dtype=np.int64)
            ids[np.arange(int(own.sum())) + np.repeat(np.arange(len(own)), own)] = values[begin : ends[last - 1]]
            while len(ids) > 2 * SLICE:
                cut = np.flatnonzero(ids[SLICE:] == -1)[0] + SLICE + 1
                yield ids[:cut]
                ids = ids[cut:]
            yield ids
            first = last


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys and their counts in few bytes: steps from key to key and counts less 1, by bytes of like weight, deflated."""
    out = []
    for values in (np.diff(keys, prepend=0), counts - 1):
        width = max(1, (int(values.max()).bit_length() + 7) // 8)
        out += [bytes([width]), values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return len(keys).to_bytes(8, "little") + zlib.compress(b"".join(out), 1)


def unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, data, out, at = int.from_bytes(block[:8], "little"), np.frombuffer(zlib.decompress(block[8:]), dtype=np.uint8), [], 0
    for _ in range(2):
        width = int(data[at])
        values = np.zeros((n, 8), dtype=np.uint8)
        values[:, :width] = data[at + 1 : at + 1 + n * width].reshape(width, n).T
        out.append(values.view("<u8")[:, 0].astype(np.int64))
        at += 1 + n * width
    return np.cumsum(out[0]), out[1] + 1


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and the sums of their counts."""
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.zeros(len(keys), dtype=np.int64)
    np.add.at(counts, place, np.concatenate([c for _, c in parts]))
    return keys, counts


def dealt(keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A packed block for each bucket of the keys."""
    own = (common.mix(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(own, kind="stable")
    own, keys, counts = own[order], keys[order], counts[order]
    some, begins = np.unique(own, return_index=True)
    ends = np.append(begins[1:], len(own))
    rows = [packed(keys[a:b], counts[a:b]) for a, b in zip(begins, ends)]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "block"])


def trie_pass(runs: DataFrame, trie: DoubleArray, length: int, entries: int, buckets: int = 1) -> DataFrame:
    """Stored sums of a pass that reach MIN: (entry, null, c) of each candidate of `length` words, and (entry, last word,
    c) of the words that follow it where the candidate at the next place stands too.

    Most pairs of a task stand once in it, so its sums are as many as its places. They are shuffled as packed blocks, one for
    each bucket of the keys (3 bytes a pair, where rows took 10)."""
    shared = common.share(runs.sparkSession, trie, views=True)
    symbols = trie.symbols  # a key is entry * (symbols + 1) + last + 1, without the last word + 0

    def run(batches):
        trie, accepted, following, held = shared(), np.zeros(entries, dtype=np.int64), [], 0
        for ids in run_slices(batches):
            state = ids
            for level in range(1, length):
                state = trie.step(state[:-1], ids[level:])
            entry = np.where(state >= 0, trie.index[state], -1).astype(np.int64) if length > 1 else ids
            if length > 1:
                accepted += np.bincount(entry[entry >= 0], minlength=entries)
            if length == LONGEST:
                continue
            both = np.flatnonzero((entry[:-1] >= 0) & (entry[1:] >= 0))
            following.append(np.unique(entry[both] * (symbols + 1) + ids[both + length] + 1, return_counts=True))
            held += len(following[-1][0])
            if held > HELD:
                following = [summed(following)]
                held = len(following[0][0])
                if held > HELD // 2:
                    yield dealt(*following[0], buckets)
                    following, held = [], 0
        some = np.flatnonzero(accepted)
        following.append((some * (symbols + 1), accepted[some]))
        yield dealt(*summed(following), buckets)

    def add(batches):
        last, own, held = None, [], 0

        def rows():
            keys, counts = summed(own)
            keys, counts = keys[counts >= MIN], counts[counts >= MIN]
            word = keys % (symbols + 1)
            return pa.RecordBatch.from_arrays(
                [pa.array((keys // (symbols + 1)).astype(np.int32)), pa.array((word - 1).astype(np.int32), mask=word == 0), pa.array(counts)],
                names=["entry", "last", "c"],
            )

        for batch in batches:
            for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block")):
                if bucket != last and own:
                    yield rows()
                    own, held = [], 0
                last = bucket
                own.append(unpacked(block.as_buffer()))
                held += len(own[-1][0])
                if held > 2 * HELD:
                    own = [summed(own)]
                    held = 0
        if own:
            yield rows()

    blocks = runs.mapInArrow(run, "bucket int, block binary").repartition("bucket").sortWithinPartitions("bucket")
    return common.stored(blocks.mapInArrow(add, "entry int, last int, c long"), "counts")


def shuffled_pass(runs: DataFrame, length: int) -> DataFrame:
    """ids, f of the frequent phrases of `length` words, when their candidates are too many for a trie."""
    at = F.sequence(F.lit(1), F.size("ids") - (length - 1))
    windows = runs.filter(F.size("ids") >= length).select(F.explode(F.transform(at, lambda i: F.slice("ids", i, length))).alias("ids"))
    counted = windows.filter(~F.array_contains("ids", -1)).groupBy("ids").agg(F.count("*").alias("f"))
    return common.stored(counted.filter(F.col("f") >= MIN), "phrases")


def phrases(runs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """ids, f of every phrase of 2 to LONGEST words with f of MIN or more."""
    symbols, places = vocabulary.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
    buckets = 1 + places // HELD
    found, levels, tried = [], [], symbols <= TRIE_NODES
    entries = vocabulary.select(F.col("id").alias("entry"), F.array("id").alias("ids"))
    for length in range(1, LONGEST + 1):
        nodes = sum(len(parents) for parents, _ in levels)
        if not tried or nodes > TRIE_NODES:
            found += [shuffled_pass(runs, k) for k in range(max(length, 2), LONGEST + 1)]
            break

        def fill(trie):
            states = trie.add_levels(levels)[-1] if levels else np.arange(symbols)
            trie.index[states] = np.arange(len(states))

        size = len(levels[-1][0]) if levels else symbols
        counts = trie_pass(runs, built(symbols, nodes, fill), length, size, buckets)
        if length > 1:
            f = counts.filter("last is null").select("entry", F.col("c").alias("f"))
            found.append(entries.join(f, "entry").select("ids", "f"))
        if length == LONGEST:
            break
        longer = counts.filter("last is not null").join(entries, "entry").select("entry", "last", F.concat("ids", F.array("last")).alias("ids"))
        following = numbered(longer, "number", "candidates")
        size = following.count()
        if not size:
            break
        if nodes + size > TRIE_NODES:
            tried = False
            continue
        own = following.select("number", F.col("entry"), "last").toArrow()  # at most TRIE_NODES rows
        order = np.argsort(own.column("number").to_numpy())
        levels.append((own.column("entry").to_numpy()[order].astype(np.int64), own.column("last").to_numpy()[order].astype(np.int64)))
        entries = following.select(F.col("number").alias("entry"), "ids")
    out = found[0] if found else runs.sparkSession.createDataFrame([], "ids array<int>, f long")
    for more in found[1:]:
        out = out.unionByName(more)
    return common.stored(out, "phrases")


def scored(frequent: DataFrame, vocabulary: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, ids, a, l, r, n, score of the phrases (ids, f) that stay."""
    parts = frequent.unionByName(vocabulary.select(F.array("id").alias("ids"), "f"))
    cut = F.explode(F.sequence(F.lit(1), F.size("ids") - 1))
    cuts = frequent.select("ids", F.col("f").alias("a"), cut.alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("first"), F.slice("ids", F.col("k") + 1, F.size("ids")).alias("rest"))
    cuts = cuts.join(parts.select(F.col("ids").alias("first"), F.col("f").alias("l")), "first")
    cuts = cuts.join(parts.select(F.col("ids").alias("rest"), F.col("f").alias("r")), "rest")
    named = vocabulary.select(F.col("id").alias("head"), "lang").join(F.broadcast(totals), "lang")
    cuts = cuts.withColumn("head", F.get("ids", F.lit(0))).join(named, "head")
    exact = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = cuts.withColumn("score", exact).groupBy("lang", "ids", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # every shorter phrase inside a phrase, with the most that a longer one around it occurs
    spots = F.explode(
        F.filter(
            F.flatten(F.transform(F.sequence(F.lit(2), F.size("ids") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("ids") - k + 1), lambda i: F.slice("ids", i, k)))),
            lambda p: F.size(p) > 1,
        )
    )
    around = frequent.filter(F.size("ids") > 2).select("f", spots.alias("ids")).groupBy("ids").agg(F.max("f").alias("longer"))
    kept = best.join(around, "ids", "left").filter(F.coalesce("longer", F.lit(0)) < F.col("a"))
    return kept.select("lang", "ids", "a", "best.l", "best.r", "n", "best.score")


def mine(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` collocations of each language."""
    docs = languages(docs)
    counts = common.stored(word_counts(docs), "words")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    vocabulary = numbered(counts.filter("word is not null"), "id", "vocabulary")
    frequent = phrases(encode(docs, vocabulary), vocabulary)
    best = scored(frequent, vocabulary, totals)
    spelled = best.select("*", F.posexplode("ids").alias("nth", "id")).join(vocabulary.select("id", "word"), "id")
    word = F.array_sort(F.collect_list(F.struct("nth", "word")))
    named = spelled.groupBy("lang", "ids", "a", "l", "r", "n", "score").agg(word.alias("words"))
    named = named.withColumn("phrase", F.array_join(F.col("words.word"), " "))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the collocations of each language."""
    return mine(common.table(spark, sf_dir, "documents"))


SQL = r"""
with lowered as (
  select row_number() over () as doc, coalesce(lang, 'und') as lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents
),
cut as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from lowered),
pieces as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') as w from cut),
totals as (select lang, cast(sum(len(w)) as bigint) as n from pieces group by lang),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from pieces),
grams as (
  select lang, w[i:i + k - 1] as p from starts, (values (1), (2), (3), (4), (5)) as sizes(k) where i + k - 1 <= len(w)
),
freq as (select lang, p, count(*) as f from grams group by lang, p having count(*) >= 100),
cuts as (
  select c.lang, c.p, c.f as a, k, l.f as l, r.f as r
  from (select *, unnest(range(1, len(p))) as k from freq where len(p) > 1) c
  join freq l on l.lang = c.lang and l.p = c.p[1:k]
  join freq r on r.lang = c.lang and r.p = c.p[k + 1:]
),
scores as (
  select lang, p, a, l, r, n, cast((1000::hugeint * a * n) // (l::hugeint * r) as bigint) as score, k from cuts join totals using (lang)
),
best as (select * from scores qualify row_number() over (partition by lang, p order by score, k) = 1),
inner_ones as (
  select distinct s.lang, s.p[i:i + k - 1] as p, s.f
  from (select *, unnest(range(1, len(p))) as i from freq where len(p) > 2) s, (values (2), (3), (4)) as sizes(k)
  where i + k - 1 <= len(s.p) and k < len(s.p)
  union all
  select lang, p[len(p) - k + 1:] as p, f from freq, (values (2), (3), (4)) as sizes(k) where k < len(p)
),
around as (select lang, p, max(f) as longer from inner_ones group by lang, p),
kept as (
  select b.lang, array_to_string(b.p, ' ') as phrase, a, l, r, n, score
  from best b left join around o on o.lang = b.lang and o.p = b.p where coalesce(o.longer, 0) < b.a
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept qualify rank <= 2000
"""
