"""MinHash near-duplicates with tensored banding, confirmed on full sets.

Ordinary banding of K minhashes a key and L tables takes K * L minhashes. Here two collections of SIDE short keys
(WIDTH minhashes each) are computed, and a table key is a pair, one key of each collection: SIDE ** 2 tables of
2 * WIDTH minhashes a key from 2 * SIDE * WIDTH minhashes, about the square root (120 instead of 2,400). Two
sets of similarity s share a table key if they share a key of either collection: with probability
(1 - (1 - s ** WIDTH) ** SIDE) ** 2. At s = 0.8 that misses 1.2 in a million, at 0.9 five in a million millions.

A pair of keys can only be shared if both its halves are, so halves that stand in one document only go before pairs
are formed; that loses nothing and leaves few pairs. Documents with a table key in common are joined into families.
Every family is resolved exactly on the full shingle sets, by searches that hold a document only against those not
yet reached: a document that is linked needs no more comparisons than to find it. Families of up to FAMILY
shingles are worked on as a whole, several in a task. Larger ones, which may hold a third of all documents, are cut
into blocks of about BLOCK shingles. First all members are held against the member that shares most table keys. Those it
links to are one group and need no comparison among each other; the rest is held, block against block, against itself
and against those members that the triangle inequality of Jaccard distance allows to link to it. A task holds
two blocks, whatever the size of the family, and gives back links that join its groups (fewer than documents), not pairs.

Equal sets are one class from the start, so any number of copies is one member. Shingles are 64-bit hashes; classes are
told apart by 128-bit digests and named by a row number of the stored scan.

Edge cases: null text, or text without words: 0 shingles, linked with nothing. A row without doc_id takes no part: its
component is null and it is kept. Rows that share a doc_id are judged by their own text each; repeated rows come out
as often as they stand. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import groups

WORDS = 4
NUM, DEN = 80, 100  # similarity at least NUM / DEN
WIDTH, SIDE = 3, 20
FAMILY = 1 << 21  # shingles of a family that one task resolves as a whole
BLOCK = 1 << 20  # shingles of a block of a larger family
SALTS = 16  # parts of a large family while its sets are cut into blocks
SLACK = 1e-9

_HASHES = 2 * SIDE * WIDTH


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    numbers = common.mix(np.arange(1, 2 * _HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return numbers[:_HASHES] | np.uint64(1), numbers[_HASHES:]


def signatures(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minhashes of the sets that begin at starts in own (none empty): one row a set."""
    times, plus = _multipliers()
    out = np.empty((len(starts), _HASHES), dtype=np.uint64)
    for k in range(_HASHES):
        mixed = own * times[k] + plus[k]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9FB21C651E98DF25)
        mixed ^= mixed >> np.uint64(28)
        out[:, k] = np.minimum.reduceat(mixed, starts)
    return out


def halves(minhashes: np.ndarray) -> np.ndarray:
    """The 2 * SIDE short keys of each row; the place of a key is part of it."""
    parts = minhashes.reshape(len(minhashes), 2 * SIDE, WIDTH)
    keys = np.broadcast_to(np.arange(1, 2 * SIDE + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(WIDTH):
        keys = common.mix(keys * np.uint64(common.BASE) + parts[:, :, k])
    return keys


def digest(own: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)


def overview(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Stored rows: row (a number of its own), doc_id, n, k1, k2 (digest of the set), keys (empty if n is 0)."""

    def scan(batches):
        for batch in batches:
            n = np.zeros(batch.num_rows, dtype=np.int64)
            digests = np.zeros((batch.num_rows, 2), dtype=np.int64)
            keys = np.zeros((batch.num_rows, 2 * SIDE), dtype=np.int64)
            pending, rows, held = [], [], 0

            def flush():
                starts = np.concatenate([[0], np.cumsum([len(x) for x in pending])[:-1]])
                keys[rows] = halves(signatures(np.concatenate(pending), starts)).view(np.int64)

            for row, own in common.shingle_sets(batch.column("text"), words):
                n[row] = len(own)
                if not len(own):
                    continue
                digests[row] = digest(own)
                pending.append(own)
                rows.append(row)
                held += len(own)
                if held > 1 << 15:
                    flush()
                    pending, rows, held = [], [], 0
            if rows:
                flush()
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, 2 * SIDE, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[n > 0].ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(digests[:, 0]), pa.array(digests[:, 1]), lists],
                names=["doc_id", "n", "k1", "k2", "keys"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, k1 long, k2 long, keys array<bigint>"
    scanned = docs.select("doc_id", "text").mapInArrow(scan, schema)
    return common.stored(scanned.select(F.monotonically_increasing_id().alias("row"), "*"), "overview")


def table_keys(nodes: DataFrame) -> DataFrame:
    """key, node: the table keys of each node (node, keys) whose halves both stand in other nodes as well."""
    half = nodes.select("node", F.posexplode("keys").alias("place", "half"))
    shared = half.groupBy("half").agg(F.count("*").alias("c")).filter("c > 1").select("half")
    kept = half.join(shared, "half", "left_semi")
    first, second = (
        F.collect_list(F.when(side, F.col("half"))).alias(name) for name, side in (("a", F.col("place") < SIDE), ("b", F.col("place") >= SIDE))
    )
    pairs = kept.groupBy("node").agg(first, second).filter("size(a) > 0 and size(b) > 0")
    tensor = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))
    return pairs.select("node", F.explode(tensor).alias("key"))


def families(nodes: DataFrame) -> DataFrame:
    """node, label (of its family), shares (table keys it has in common with others); members of families of two or more."""
    keys = common.stored(table_keys(nodes), "keys")
    met = keys.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("c")).filter("c > 1").select("key", "head")
    shared = keys.join(met, "key").groupBy("node", "head").agg(F.count("*").alias("shares"))
    # all heads of a node meet in its smallest one: many nodes of a dense family then give the same few links
    stars = shared.groupBy("node").agg(F.sum("shares").alias("shares"), F.min("head").alias("a"), F.collect_set("head").alias("heads"))
    stars = common.stored(stars, "stars")
    among = stars.select("a", F.explode("heads").alias("b")).unionByName(stars.select("a", F.col("node").alias("b")))
    labels = groups(common.stored(among.filter("a <> b").distinct(), "links"))
    return common.stored(labels.join(stars.select("node", "shares"), "node"), "families")


def family_sets(docs: DataFrame, members: DataFrame, words: int = WORDS) -> DataFrame:
    """The columns of members (node, doc_id, k1, k2, ...) with own, the shingles; a row a member."""

    def run(batches):
        for batch in batches:
            values, sizes, digests, held = [], [], [], 0
            for _, own in common.shingle_sets(batch.column("text"), words):
                if len(own):
                    values.append(own.view(np.int64))
                    sizes.append(len(own))
                    digests.append(digest(own))
                    held += len(own)
                if held > 1 << 18:
                    yield out(values, sizes, digests)
                    values, sizes, digests, held = [], [], [], 0
            if values:
                yield out(values, sizes, digests)

    def out(values, sizes, digests):
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        both = np.array(digests)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), lists], names=["k1", "k2", "own"])

    # one text of each class: that of the row that names it, found by id and then told apart by its digest
    wanted = common.stored(members.select(F.col("doc_id").alias("doc")).distinct(), "wanted")
    texts = common.among(docs.select("doc_id", "text"), wanted)
    sets = texts.select("text").mapInArrow(run, "k1 long, k2 long, own array<bigint>")
    return members.join(sets.dropDuplicates(["k1", "k2"]), ["k1", "k2"])


# ---------------------------------------------------------------- exact links inside a task


def linked(shared, n, m):
    return shared * DEN >= (n + m - shared) * NUM


def forest(nodes: np.ndarray, values: np.ndarray, sizes: np.ndarray, others: np.ndarray | None = None, same: np.ndarray | None = None):
    """Links that join what is linked directly or through others: (one, other) node numbers, fewer than nodes.

    others: only pairs of a node where it is true and any other node count (default: all pairs).
    same: nodes with equal numbers of 0 or more here are known to be linked already."""
    count, where = len(nodes), np.repeat(np.arange(len(nodes)), sizes)
    _, code, times = np.unique(values, return_inverse=True, return_counts=True)
    useful = times[code] > 1  # what stands in one set only is in no intersection
    code, where = code[useful], where[useful]
    begins = np.searchsorted(where, np.arange(count + 1))
    marked = np.zeros(len(times), dtype=bool)
    open_, links = np.ones(count, dtype=bool), []
    waiting = np.arange(count)
    active = np.ones(count, dtype=bool) if others is None else others
    group = np.full(count, -1) if same is None else same
    if others is None and same is None:
        return _searched(nodes, sizes, code, begins, marked, open_, links)
    # a pair is compared only while the groups of its nodes differ
    top = np.arange(count)
    known: dict[int, int] = {}
    for i in np.flatnonzero(group >= 0):
        top[i] = known.setdefault(int(group[i]), i)
    for x in np.flatnonzero(active):
        rest = np.flatnonzero((top != top[x]) & (~active | (waiting > x)) & _sizes_fit(sizes, sizes[x]))
        if not len(rest):
            continue
        for y in rest[_linked_to(x, rest, sizes, code, begins, marked)]:
            if top[x] != top[y]:
                top[top == top[y]] = top[x]
                links.append((nodes[x], nodes[y]))
    return links


def _sizes_fit(n, m):
    return np.minimum(n, m) * DEN >= np.maximum(n, m) * NUM


def _linked_to(x, rest, sizes, code, begins, marked) -> np.ndarray:
    """Which of rest are linked to x; exact counts of common elements."""
    own = code[begins[x] : begins[x + 1]]
    marked[own] = True
    lengths = begins[rest + 1] - begins[rest]
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1]) + np.repeat(begins[rest] - (ends - lengths), lengths)
    hits = np.concatenate([[0], np.cumsum(marked[code[at]])])
    marked[own] = False
    return linked(hits[ends] - hits[ends - lengths], sizes[rest], sizes[x])


def _searched(nodes, sizes, code, begins, marked, open_, links):
    """All pairs: each search takes what it reaches out of the open nodes."""
    for first in range(len(nodes)):
        if not open_[first]:
            continue
        open_[first] = False
        reached = [first]
        while reached:
            x = reached.pop()
            rest = np.flatnonzero(open_ & _sizes_fit(sizes, sizes[x]))
            if len(rest):
                found = rest[_linked_to(x, rest, sizes, code, begins, marked)]
                open_[found] = False
                links += [(nodes[x], nodes[y]) for y in found]
                reached += found.tolist()
    return links


def _edges(links) -> pa.RecordBatch:
    both = np.array(links, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _by_label(batches, column: str) -> Iterator[pa.Table]:
    """Rows of sorted batches, a table for each value of column; several values may share one."""
    held: list[pa.RecordBatch] = []
    size, budget = 0, FAMILY
    for batch in batches:
        while batch.num_rows:
            if held and size >= budget:
                last = held[-1].column(column)[-1]
                other = np.flatnonzero(batch.column(column).to_numpy(zero_copy_only=False) != last.as_py())
                cut = int(other[0]) if len(other) else batch.num_rows
                held.append(batch.slice(0, cut))
                batch = batch.slice(cut)
                if len(other):
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                continue
            held.append(batch)
            size += len(batch.column("own").flatten())
            batch = batch.slice(batch.num_rows)
    if held:
        yield pa.Table.from_batches(held)


def _unpacked(table: pa.Table, column: str):
    """For each value of column: node numbers, shingles, sizes, and the rows they stand in."""
    labels = table.column(column).to_numpy()
    nodes = table.column("node").to_numpy()
    chunks = table.column("own").chunks
    lists = chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks)  # not copied if it is one
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    values, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
    cuts = np.flatnonzero(labels[1:] != labels[:-1]) + 1
    for a, b in zip([0, *cuts], [*cuts, len(labels)]):
        yield slice(a, b), nodes[a:b], values[ends[a] : ends[b]], sizes[a:b]


def small_links(rows: DataFrame) -> DataFrame:
    """a, b: links that join the groups of each family (label, node, own)."""

    def run(batches):
        for table in _by_label(batches, "label"):
            links = []
            for _, nodes, values, sizes in _unpacked(table, "label"):
                links += forest(nodes, values, sizes)
            yield _edges(links)

    dealt = rows.select("label", "node", "own").repartition("label").sortWithinPartitions("label")
    return dealt.mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- families too large for one task


def large_links(rows: DataFrame) -> DataFrame:
    """a, b: links that join the groups of each large family (label, node, n, shares, own; stored)."""
    centre = rows.groupBy("label").agg(F.max(F.struct("shares", "node")).alias("c")).select("label", F.col("c.node").alias("centre"))
    middle = rows.join(centre.select(F.col("centre").alias("node")), "node", "left_semi").select(
        "label", F.col("node").alias("centre"), F.col("own").alias("middle")
    )
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    shared = F.size(F.array_intersect("own", "middle"))
    placed = salted.join(middle.withColumn("salt", salts), ["label", "salt"]).withColumn("shared", shared)
    placed = placed.withColumn("d", 1 - F.col("shared") / (F.col("n") + F.size("middle") - F.col("shared"))).withColumn(
        "inside", linked(F.col("shared"), F.col("n"), F.size("middle"))
    )
    placed = common.stored(placed.select("label", "node", "centre", "n", "own", "d", "inside"), "placed")
    star = placed.filter(F.col("inside") & (F.col("node") != F.col("centre"))).select(F.col("centre").alias("a"), F.col("node").alias("b"))

    # a member nearer to the centre than the nearest outsider less the reach of a link can't be linked to any outsider
    nearest = placed.filter("not inside").groupBy("label").agg(F.min("d").alias("nearest"))
    reach = 1 - NUM / DEN + SLACK
    rest = placed.join(F.broadcast(nearest) if nearest.count() <= common_bound() else nearest, "label")
    rest = rest.filter(~F.col("inside") | (F.col("d") >= F.col("nearest") - reach))
    sizes = rest.groupBy("label", "inside").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    outside = sizes.filter("not inside").select("label", F.col("blocks").alias("n_out"))
    inner = sizes.filter("inside").select("label", F.col("blocks").alias("n_in"))
    counts = outside.join(inner, "label", "left").select("label", "n_out", F.coalesce("n_in", F.lit(0)).alias("n_in"))
    rest = rest.join(counts, "label")
    # the outsiders' blocks are 0 .. n_out - 1; a task is an outsiders' block i and a block j not before it
    spread = F.pmod(F.xxhash64("node", F.lit(1)), F.when(F.col("inside"), F.col("n_in")).otherwise(F.col("n_out")))
    block = F.when(F.col("inside"), F.col("n_out") + spread).otherwise(spread)
    rest = rest.withColumn("block", block)
    as_first = F.when(~F.col("inside"), F.transform(F.sequence(F.col("block"), F.col("n_out") + F.col("n_in") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"))))
    least = F.when(F.col("inside"), F.col("n_out")).otherwise(F.col("block")) - 1
    as_second = F.when(least >= 0, F.transform(F.sequence(F.lit(0).cast("long"), least), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"))))
    none = F.array().cast("array<struct<i:bigint,j:bigint>>")
    tasks = F.explode(F.concat(F.coalesce(as_first, none), F.coalesce(as_second, none)))
    dealt = rest.select("label", "node", "own", "inside", "block", tasks.alias("t")).withColumn("task", F.xxhash64("label", "t.i", "t.j"))

    def run(batches):
        for table in _by_label(batches, "task"):
            links, inside, block, i = [], *(table.column(c).to_numpy() for c in ("inside", "block", "i"))
            for at, nodes, values, sizes in _unpacked(table, "task"):
                inner = np.where(inside[at], 0, -1)
                links += forest(nodes, values, sizes, block[at] == i[at], inner)
            yield _edges(links)

    columns = dealt.select("task", "node", "own", "inside", "block", F.col("t.i").alias("i"))
    found = columns.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")
    return star.unionByName(found)


def common_bound() -> int:
    """Rows (label, distance) that may be broadcast: 16 MB."""
    return 1_000_000


# ---------------------------------------------------------------- the operator


def components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    docs = docs.select("doc_id", "text")
    seen = overview(docs, words)
    classes = common.stored(
        seen.filter("doc_id is not null and n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("first"), F.min("row").alias("node")),
        "classes",
    )
    nodes = seen.join(classes.select(F.col("node").alias("row")), "row", "left_semi")
    found = families(nodes.select(F.col("row").alias("node"), "keys"))
    members = found.join(seen.select(F.col("row").alias("node"), "doc_id", "k1", "k2", "n"), "node")
    weights = members.groupBy("label").agg(F.sum("n").alias("total"))
    sets = common.stored(family_sets(docs, members.join(weights, "label"), words), "sets")
    small, large = sets.filter(F.col("total") <= FAMILY), sets.filter(F.col("total") > FAMILY)
    edges = common.stored(small_links(small), "links")
    if not large.isEmpty():
        edges = edges.unionByName(common.stored(large_links(large), "large"))
    labels = groups(edges)
    joined = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = joined.groupBy("label").agg(F.min("first").alias("component"))
    named = joined.join(least, "label").select("k1", "k2", "n", "component")
    # rows without an id take no part, though their text may be a class
    rows = seen.withColumn("known", F.col("doc_id").isNotNull() & (F.col("n") > 0)).select("doc_id", "n", "k1", "k2", "known")
    rows = rows.join(named.withColumn("known", F.lit(True)), ["k1", "k2", "n", "known"], "left")
    component = F.coalesce("component", "doc_id")
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the group of every document, and whether it is the one that stays."""
    return components(common.table(spark, sf_dir, "documents"))
