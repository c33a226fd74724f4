"""Exact n-gram Jaccard join and its connected groups, as a metric-space join.

Jaccard distance is a metric, but texts that share no shingle all lie at distance 1, where the triangle
inequality says nothing. So the space is first cut into what can be connected at all, without losing a link: of two
sets with similarity s or more, the first n - ceil(s n) + l shingles in any fixed total order have l in common. l is
a share (EXTRA) of a set's size, and the sizes of linked sets differ by the factor s at most, so a set with fewer
shingles in common with others than s l has no partner and goes at once; a passage that stands in other texts too is not
enough. What is left is paired with whatever shares a shingle that few others hold, and the shared ones of each pair are
counted; those that many hold count as shared by all of them. Pairs with enough are linked, sets with enough frequent ones
through a set of those that hold them, and what is linked directly or through others is a region. So texts that have a
chance shingle each in common with many others form no chain through the corpus. The order puts shingles
that a count sketch of the whole corpus shows as frequent last; the sketch decides cost only, never results.

A region is joined recursively, with e = 1 - s. Pivots far from each other are chosen and exact distances to them are
computed; a document within e of a pivot is linked to it and needs no comparison with the others there. Every document
belongs to its nearest pivot's region. Of a linked pair x, y with nearest pivots p, q the triangle inequality
gives d(y, p) <= d(y, q) + 2 e, so a document is also replicated, as a guest, to every region whose pivot is at most
2 e farther than its own. Guests outside the window of the region's own distances, less and plus e, are dropped.
Regions are joined in turn: members of one group are not compared again, small regions are compared directly, and so
are those that do not get smaller (where all distances to pivots are alike the inequality excludes nothing).

Regions of up to REGION shingles are joined inside a task, several in one. Larger ones, which may hold a third of all
documents, are first cut by size (linked sets lie in one class of sizes or in neighbouring ones), then split by
the same rule as a Spark job, round by round. What does not shrink is dealt out as pairs
of blocks of about BLOCK shingles. Tasks give back links that join their groups, fewer than documents, not pairs.

Equal sets are one class from the start. Shingles are 64-bit hashes, equal sets have equal 128-bit digests.

Edge cases: null text, or text without words: 0 shingles, linked with nothing. A null doc_id has a null component and
takes no part. Rows that share a doc_id are judged by their own text each; repeated rows come out as often as they
stand. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .graph import groups
from .minhash_dedup import _by_label, _edges, _unpacked, digest, family_sets

WORDS = 5
NUM, DEN = 75, 100  # similarity at least NUM / DEN
EXTRA_NUM, EXTRA_DEN = 5, 100  # share of a set that its prefix is longer than one common shingle needs
SKETCH_LOG2 = 20  # counters
FEW = 8  # holders of a shingle that are paired with each other
SALTS = 64  # parts of a frequent shingle's rows, and of a large region's
SLICE = 1 << 16
REGION = 1 << 24  # shingles of a region that one task joins
BLOCK = 1 << 22  # shingles of a block of a region that pivots don't make smaller
PIVOTS = 8  # of a large region in a round
DIRECT = 48  # documents of a region that are compared directly

EPS = 1 - NUM / DEN
SLACK = 1e-9


def overview(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Stored rows: (row, doc_id, n, k1, k2) of each document, and slices of each task's count sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow_kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())
    size = 1 << SKETCH_LOG2

    def scan(batches):
        sketch = np.zeros(size, dtype=np.uint32)
        for batch in batches:
            n = np.zeros(batch.num_rows, dtype=np.int64)
            keys = np.zeros((batch.num_rows, 2), dtype=np.int64)
            pending, held = [], 0
            for row, own in common.shingle_sets(batch.column("text"), words):
                n[row] = len(own)
                if len(own):
                    keys[row] = digest(own)
                    pending.append(own)
                    held += len(own)
                    if held > 1 << 18:
                        np.add.at(sketch, (np.concatenate(pending) >> np.uint64(64 - SKETCH_LOG2)).astype(np.int64), 1)
                        pending, held = [], 0
            if pending:
                np.add.at(sketch, (np.concatenate(pending) >> np.uint64(64 - SKETCH_LOG2)).astype(np.int64), 1)
            none = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(keys[:, 0]), pa.array(keys[:, 1]), *none], names=names
            )
        for nth in range(size // SLICE):
            part = sketch[nth * SLICE : (nth + 1) * SLICE]
            if part.any():
                none = pa.nulls(1, arrow_kind), *(pa.nulls(1, pa.int64()) for _ in range(3))
                packed = zlib.compress(part.astype("<u8").tobytes(), 1)
                yield pa.RecordBatch.from_arrays([*none, pa.array([nth], pa.int32()), pa.array([packed])], names=names)

    names = ["doc_id", "n", "k1", "k2", "slice", "counts"]
    schema = f"doc_id {kind}, n long, k1 long, k2 long, slice int, counts binary"
    scanned = docs.select("doc_id", "text").mapInArrow(scan, schema)
    return common.stored(scanned.select(F.monotonically_increasing_id().alias("row"), "*"), "overview")


def frequency_classes(seen: DataFrame) -> np.ndarray:
    """For each counter 0, or 1 + log2 of how far it stands above the mean of all counters."""
    slices = seen.filter("slice is not null").select("slice", "counts")

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for nth, packed in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                own = np.frombuffer(zlib.decompress(packed), dtype="<u8")
                totals[nth] = totals[nth] + own if nth in totals else own
        for nth, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([nth], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)])], names=["slice", "counts"]
            )

    merged = slices.repartition(16, "slice").mapInArrow(add, "slice int, counts binary").collect()  # fixed size
    counts = np.zeros(1 << SKETCH_LOG2, dtype=np.uint64)
    for row in merged:
        counts[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(zlib.decompress(row["counts"]), dtype="<u8")
    mean = counts.mean()
    above = counts - mean
    hot = above > 8 * np.sqrt(mean) + 8
    out = np.zeros(len(counts), dtype=np.uint8)
    out[hot] = 1 + np.log2(above[hot]).astype(np.uint8)
    return out


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    more = max(1, -(-EXTRA_NUM * n // EXTRA_DEN))
    return min(n, n - -(-num * n // den) + more) if n else 0


def least_shared(n):
    """How many shingles of its prefix a set of n has in common with any partner at least: the smallest partner's share."""
    smallest = F.ceil(n * NUM / DEN)
    return F.greatest(F.lit(1), F.ceil(smallest * EXTRA_NUM / EXTRA_DEN))


def pair_shares(n):
    """How many shingles of their prefixes a set of n and any linked one that is not smaller have in common at least."""
    return F.greatest(F.lit(1), F.ceil(n * EXTRA_NUM / EXTRA_DEN))


def ordered_prefix(own: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles in the order (frequency class, hash), and whether each is frequent."""
    cls = classes[(own >> np.uint64(64 - SKETCH_LOG2)).astype(np.int64)]
    length = prefix_length(len(own))
    if cls.any():
        order = np.argsort(cls, kind="stable")[:length]  # own is sorted by hash
        return own[order], cls[order] > 0
    return own[:length], np.zeros(length, dtype=bool)


def postings(docs: DataFrame, classes: np.ndarray, words: int = WORDS) -> DataFrame:
    """h, k1, n, hot: the prefix of each document's set; a task gives that of equal sets once (while it remembers)."""
    shared = common.share(docs.sparkSession, classes)

    def emit(batches):
        classes, known = shared(), set()
        for batch in batches:
            hashes, sets, sizes, hots, held = [], [], [], [], 0

            def flush():
                columns = np.concatenate(hashes).view(np.int64), np.concatenate(sets), np.concatenate(sizes), np.concatenate(hots)
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "k1", "n", "hot"])

            for _, own in common.shingle_sets(batch.column("text"), words):
                if not len(own) or (key := int(digest(own)[0])) in known:
                    continue
                if len(known) > 200_000:
                    known.clear()
                known.add(key)
                prefix, hot = ordered_prefix(own, classes)
                hashes.append(prefix)
                hots.append(hot)
                sets.append(np.full(len(prefix), key, dtype=np.int64))
                sizes.append(np.full(len(prefix), len(own), dtype=np.int32))
                held += len(prefix)
                if held > 1 << 17:
                    yield flush()
                    hashes, sets, sizes, hots, held = [], [], [], [], 0
            if hashes:
                yield flush()

    return docs.select("text").mapInArrow(emit, "h long, k1 long, n int, hot boolean")


def linked(common_, n, m):
    return common_ * DEN >= (n + m - common_) * NUM


def size_class(n):
    """Sizes that allow a link lie in the same class or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(DEN / NUM)) + SLACK).cast("int")


def connected(posted: DataFrame) -> DataFrame:
    """k1, region: sets that share enough posted shingles with one set of a fitting size, in regions of such pairs."""
    # frequent shingles are cut into parts here; that they are shared needs no proof
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("k1"), F.lit(SALTS)) + 1).otherwise(0)
    by_set = Window.partitionBy("h", "salt").orderBy("n", "k1")
    once = posted.withColumn("salt", salt).withColumn("before", F.lag("k1").over(by_set))
    once = once.filter("before is null or before <> k1")  # equal sets of several tasks
    fits_below = F.lag("n").over(by_set) * DEN >= F.col("n") * NUM
    fits_above = F.lead("n").over(by_set) * NUM <= F.col("n") * DEN
    met = once.withColumn("met", F.col("hot") | F.coalesce(fits_below, F.lit(False)) | F.coalesce(fits_above, F.lit(False)))
    met = common.stored(met.filter("met").select("h", "k1", "n"), "shared")
    enough = met.groupBy("k1").agg(F.count("*").alias("c"), F.max("n").alias("n")).filter(F.col("c") >= least_shared(F.col("n")))
    own = size_class(F.col("n"))
    left = met.join(enough.select("k1"), "k1", "left_semi").select("h", "k1", "n", own.alias("own"), F.explode(F.array(own, own + 1)).alias("size_class"))
    # linked sets lie in one class together, so they share enough in the class of the larger one
    by_place = Window.partitionBy("h", "size_class").orderBy("n", "k1")
    whole = by_place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = F.collect_list(F.struct("k1", "n")).over(by_place.rowsBetween(1 - FEW, -1))
    placed = left.select("k1", "n", "own", "size_class", F.count("*").over(whole).alias("held"), F.min("k1").over(whole).alias("head"), earlier.alias("earlier"))
    fits = F.filter("earlier", lambda x: x["n"] * DEN >= F.col("n") * NUM)
    none = F.lit(None).cast("long")
    pairs = F.transform(fits, lambda x: F.struct(x["k1"].alias("a"), x["n"].alias("n"), none.alias("head")))
    many = F.array(F.struct(none.alias("a"), F.col("n"), F.col("head")))
    meets = F.when(F.col("held") > FEW, many).when(F.col("own") == F.col("size_class"), pairs)
    met = common.stored(placed.select(F.col("k1").alias("b"), "size_class", F.explode(meets).alias("to")).select("b", "size_class", "to.*"), "meetings")
    # all heads of a set meet in the smallest one, which leaves few different links in a dense place
    of_set = met.filter("a is null").groupBy(F.col("b").alias("k1"), "size_class")
    frequent = of_set.agg(F.count("*").alias("c"), F.max("n").alias("n"), F.min("head").alias("head"), F.collect_set("head").alias("heads"))
    frequent = common.stored(frequent.withColumn("heads", F.when(F.col("c") >= least_shared(F.col("n")), F.col("heads"))), "frequent")
    stars = frequent.filter("heads is not null").select("k1", "head", "heads")
    links = stars.select(F.col("head").alias("a"), F.explode("heads").alias("b")).unionByName(stars.select(F.col("head").alias("a"), F.col("k1").alias("b")))
    counted = met.filter("a is not null").groupBy("a", "b", "size_class").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    for end in "ab":
        counted = counted.join(frequent.select(F.col("k1").alias(end), "size_class", F.col("c").alias(f"{end}_frequent")), [end, "size_class"], "left")
    most = F.col("c") + F.least(F.coalesce("a_frequent", F.lit(0)), F.coalesce("b_frequent", F.lit(0)))
    linked_ = counted.filter(most >= pair_shares(F.col("n"))).select("a", "b")
    labels = groups(links.unionByName(linked_).filter("a <> b").distinct())
    return labels.select(F.col("node").alias("k1"), F.col("label").alias("region"))


# ---------------------------------------------------------------- regions inside a task


def _ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - lengths), lengths)


def coded(values: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each place of a value that stands in several places (else -1); of each number how often it stands,
    and the entries of `where` at its places, number by number.

    Values are taken by their first byte, about a million at once, as sorting all of them takes several times their memory."""
    code, times, holders, known = np.full(len(values), -1, dtype=np.int32), [], [], 0
    bits = min(8, (len(values) >> 20).bit_length())
    part = np.ascontiguousarray(values, dtype="<i8").view(np.uint8)[7::8] >> (8 - bits) if bits else np.zeros(len(values), np.uint8)
    for nth in range(1 << bits):
        at = np.flatnonzero(part == nth)
        at = at[np.argsort(values[at], kind="stable")]
        own = values[at]
        begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[: len(own)])
        n = np.diff(np.append(begins, len(own)))
        at, n = at[np.repeat(n > 1, n)], n[n > 1]
        code[at] = np.repeat(np.arange(known, known + len(n)), n)
        times.append(n)
        holders.append(where[at])
        known += len(n)
    return code, np.concatenate(times), np.concatenate(holders)


class Sets:
    """The sets of a task's region: distances between them, and the groups found so far."""

    def __init__(self, nodes: np.ndarray, values: np.ndarray, sizes: np.ndarray):
        self.nodes, self.sizes, self.links = nodes, sizes, []
        self.top = np.arange(len(nodes))
        where = np.repeat(np.arange(len(nodes), dtype=np.int32), sizes)
        code, self.times, self.holders = coded(values, where)
        useful = code >= 0  # what stands in one set only is in no intersection
        self.code = code[useful]
        self.begins = np.searchsorted(where[useful], np.arange(len(nodes) + 1, dtype=np.int32))
        self.marked = np.zeros(len(self.times), dtype=bool)
        self.ends = np.cumsum(self.times)

    def shared(self, x: int, others: np.ndarray) -> np.ndarray:
        """Numbers of elements that x has in common with each of the others: by the holders of its own elements, or by
        a look at all elements of the others, whichever are fewer."""
        own = self.code[self.begins[x] : self.begins[x + 1]]
        lengths = self.begins[others + 1] - self.begins[others]
        held = self.times[own]
        if held.sum() + len(self.nodes) < lengths.sum():
            at = _ranges(self.ends[own] - held, held)
            return np.bincount(self.holders[at], minlength=len(self.nodes))[others]
        self.marked[own] = True
        hits = np.concatenate([[0], np.cumsum(self.marked[self.code[_ranges(self.begins[others], lengths)]])])
        self.marked[own] = False
        ends = np.cumsum(lengths)
        return hits[ends] - hits[ends - lengths]

    def link(self, x: int, others: np.ndarray) -> None:
        for y in others:
            if self.top[x] != self.top[y]:
                self.top[self.top == self.top[y]] = self.top[x]
                self.links.append((self.nodes[x], self.nodes[y]))

    def measure(self, x: int, others: np.ndarray) -> np.ndarray:
        """Distances of x to the others; what is linked to it joins its group."""
        both, sizes = self.shared(x, others), self.sizes[others]
        self.link(x, others[linked(both, sizes, self.sizes[x])])
        return 1 - both / (sizes + self.sizes[x] - both)

    def compare(self, members: np.ndarray, home: np.ndarray) -> None:
        """Every home member against all members of other groups, each pair once."""
        place = np.arange(len(members))
        for at in np.flatnonzero(home):
            x = members[at]
            open_ = (self.top[members] != self.top[x]) & (~home | (place > at))
            small, large = np.minimum(self.sizes[members], self.sizes[x]), np.maximum(self.sizes[members], self.sizes[x])
            rest = members[open_ & (small * DEN >= large * NUM)]
            if len(rest):
                self.link(x, rest[linked(self.shared(x, rest), self.sizes[rest], self.sizes[x])])

    def join(self, members: np.ndarray, home: np.ndarray) -> None:
        """Links every home member with all members, region by region."""
        if len(members) < 2 or not home.any() or len(np.unique(self.top[members])) < 2:
            return
        if len(members) <= DIRECT:
            return self.compare(members, home)
        count = min(16, max(2, len(members) // 16))
        away = np.empty((count, len(members)))
        pivot = int(np.flatnonzero(home)[0])
        for k in range(count):  # each pivot is the home member farthest from those before it
            away[k] = self.measure(members[pivot], members)
            away[k, pivot] = 0
            pivot = int(np.argmax(np.where(home, away[: k + 1].min(axis=0), -1)))
        nearest, least = away.argmin(axis=0), away.min(axis=0)
        parts, total = [], 0
        for k in range(count):
            own = home & (nearest == k)
            if not own.any():
                continue
            low, high = away[k][own].min() - EPS - SLACK, away[k][own].max() + EPS + SLACK
            guests = ~own & (away[k] - least <= 2 * EPS + SLACK) & (away[k] >= low) & (away[k] <= high)
            inside = own | guests
            if len(np.unique(self.top[members[inside]])) > 1:
                parts.append((members[inside], own[inside]))
                total += int(inside.sum())
        if total > 2 * len(members) or any(len(m) > 0.8 * len(members) for m, _ in parts):
            return self.compare(members, home)
        for own_members, own_home in parts:
            self.join(own_members, own_home)


def joined_in_tasks(rows: DataFrame) -> DataFrame:
    """a, b: links that join the groups of each region (region, node, own, home)."""

    def run(batches):
        for table in _by_label(batches, "region"):
            home, links = table.column("home").to_numpy(), []
            for at, nodes, values, sizes in _unpacked(table, "region"):
                sets = Sets(nodes, values, sizes)
                sets.join(np.arange(len(nodes)), home[at])
                links += sets.links
            yield _edges(links)

    dealt = rows.select("region", "node", "own", "home").repartition("region").sortWithinPartitions("region")
    return dealt.mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- regions too large for a task


def by_size(rows: DataFrame) -> DataFrame:
    """Large regions cut by the sizes of their sets: a set is at home in its own class and a guest in the one below."""
    own = size_class(F.col("n"))
    goes = F.explode(F.array(F.struct(own.alias("c"), F.lit(True).alias("home")), F.struct((own - 1).alias("c"), F.lit(False).alias("home"))))
    dealt = rows.select("region", "node", "n", "own", goes.alias("to"))
    dealt = dealt.select(F.xxhash64("region", "to.c").alias("region"), "node", "n", "own", "to.home", F.lit(None).cast("long").alias("before"))
    used = dealt.groupBy("region").agg(F.max("home").alias("used")).filter("used").select("region")
    return dealt.join(F.broadcast(used), "region", "left_semi")


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over large regions (region, node, n, own, home): the smaller regions with the size `before` of the
    one they come from, and the links to pivots."""
    order = Window.partitionBy("region").orderBy(F.xxhash64("node"), "node")
    chosen = rows.filter("home").withColumn("llm_nth", F.row_number().over(order)).filter(F.col("llm_nth") <= PIVOTS)
    pivots = chosen.groupBy("region").agg(F.collect_list(F.struct(F.col("node").alias("p"), F.col("own").alias("set"))).alias("pivots"))
    pivots = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    met = salted.join(pivots, ["region", "salt"])
    both = F.transform("pivots", lambda p: F.struct(p["p"].alias("p"), F.size(p["set"]).alias("m"), F.size(F.array_intersect("own", p["set"])).alias("c")))
    met = met.select("region", "node", "n", "own", "home", "before", both.alias("to"))
    away = F.transform("to", lambda t: 1 - t["c"] / (F.col("n") + t["m"] - t["c"]))
    close = F.transform(F.filter("to", lambda t: linked(t["c"], F.col("n"), t["m"]) & (t["p"] != F.col("node"))), lambda t: t["p"])
    met = common.stored(met.select("region", "node", "n", "own", "home", "before", away.alias("away"), close.alias("close")), "met")
    links = met.select(F.explode("close").alias("a"), F.col("node").alias("b"))
    nearest = met.withColumn("least", F.array_min("away")).withColumn("nearest", F.array_position("away", F.col("least")).cast("int") - 1)
    at = F.sequence(F.lit(0), F.size("away") - 1)
    goes = F.filter(at, lambda q: (F.get("away", q) - F.col("least") <= 2 * EPS + SLACK))
    dealt = nearest.select("region", "node", "n", "own", "before", "home", "nearest", F.explode(goes).alias("q"))
    dealt = dealt.select(
        F.xxhash64("region", "q").alias("region"), "node", "n", "own", (F.col("home") & (F.col("q") == F.col("nearest"))).alias("home"), "before"
    )
    used = dealt.groupBy("region").agg(F.max("home").alias("used")).filter("used").select("region")
    return dealt.join(F.broadcast(used), "region", "left_semi"), links


def by_blocks(rows: DataFrame) -> DataFrame:
    """a, b: links of regions dealt out as pairs of blocks."""
    blocks = rows.groupBy("region").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    own = rows.join(blocks, "region").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pairs = own.select("region", "node", "own", "home", "block", other.alias("other"))
    task = F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other"))
    return joined_in_tasks(pairs.select(task.alias("region"), "node", "own", "home"))


def region_links(docs: DataFrame, members: DataFrame, words: int = WORDS) -> DataFrame:
    """a, b: links that join the groups of the regions of members (region, node, doc_id, k1, k2, n)."""
    # the sets themselves come in only where they are joined: with regions that a task joins, they are not stored
    totals = members.groupBy("region").agg(F.sum("n").alias("total"))
    members = common.stored(members.join(totals, "region"), "members")
    small, large = members.filter(F.col("total") <= REGION), members.filter(F.col("total") > REGION)
    found = common.stored(joined_in_tasks(family_sets(docs, small, words).withColumn("home", F.lit(True))), "links")
    if large.isEmpty():
        return found
    rows = by_size(common.stored(family_sets(docs, large, words).select("region", "node", "n", "own"), "large"))
    while True:
        totals = rows.groupBy("region").agg(F.sum("n").alias("total"))
        sized = common.stored(rows.join(F.broadcast(totals), "region"), "regions")  # a row for each part of a large region
        parts = [joined_in_tasks(sized.filter(F.col("total") <= REGION))]
        large = sized.filter(F.col("total") > REGION)
        more = not large.isEmpty()
        if more:
            shrinks = F.coalesce(F.col("total") <= 0.75 * F.col("before"), F.lit(True))
            parts.append(by_blocks(large.filter(~shrinks)))
            rows, links = split(large.filter(shrinks).withColumn("before", F.col("total")))
            parts.append(links)
        for part in parts:
            found = found.unionByName(common.stored(part, "links"))
        if not more:
            return found


# ---------------------------------------------------------------- the operator


def classed(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """The stored scan of docs, and its classes of equal sets (k1, k2, n, component: the smallest doc_id reachable)."""
    seen = overview(docs, words)
    rows = seen.filter("slice is null and doc_id is not null and n > 0")
    classes = common.stored(rows.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("node")), "classes")
    posted = postings(docs.filter("doc_id is not null"), frequency_classes(seen), words)
    members = classes.join(connected(posted), "k1")
    edges = region_links(docs, members, words)
    joined = classes.join(groups(edges), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = joined.groupBy("label").agg(F.min("doc_id").alias("component"))
    return seen.filter("slice is null").drop("slice", "counts"), joined.join(least, "label").select("k1", "k2", "n", "component")


def components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    docs = docs.select("doc_id", "text")
    rows, classes = classed(docs, words)
    # rows without an id take no part, though their text may be a class
    known = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    labelled = rows.withColumn("known", known).join(classes.withColumn("known", F.lit(True)), ["k1", "k2", "n", "known"], "left")
    return labelled.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: doc_id, n_shingles, component_id of every document."""
    return components(common.table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: of each group of near duplicates the document with the smallest id stays."""
    found = components(docs)
    gone = common.stored(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("doc")).distinct(), "copies")
    return common.among(docs, gone, "left_anti").select(*docs.columns)
