"""Memory and bytes of the operators' steps."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa

from eodscan.llm import common, jaccard_join, phrase_mining, suffix_dedup


def peak(work):
    tracemalloc.start()
    work()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_region_takes_little_more_than_its_shingles():
    rng = np.random.default_rng(1)
    sizes = np.full(2_000, 1_000)
    values = rng.integers(-(1 << 63), (1 << 63) - 1, 600_000)[rng.integers(0, 600_000, sizes.sum())]
    assert peak(lambda: jaccard_join.Sets(np.arange(2_000), values, sizes)) < 4 * values.nbytes


def test_region_counts_shared_elements():
    rng = np.random.default_rng(2)
    own = [np.unique(rng.integers(-40, 40, rng.integers(1, 60)) << (57 if i % 2 else 0)) for i in range(50)]
    sizes, values = np.array([len(x) for x in own]), np.concatenate(own)
    for copies in (1, 700):  # so many that values are taken by their first bits
        sets = jaccard_join.Sets(np.arange(50 * copies), np.tile(values, copies), np.tile(sizes, copies))
        for x in (0, 1, 49):
            want = [len(np.intersect1d(own[x], other)) for other in own]
            assert sets.shared(x, np.arange(50 * copies)).tolist() == want * copies


def test_stored_rows_leave_no_shuffle(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {name for name in disk.getAllBlocks().mkString(" ").split() if name.startswith("shuffle")}

    before = shuffles()
    kept = common.stored(spark.range(1000).repartition(3, "id"), "dealt")
    until = time.time() + 5
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - before and kept.count() == 1000


def test_sets_of_regions_are_not_stored(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*base, f"end{i}"])) for i in range(12)], "doc_id long, text string")
    own, stored = [], common.stored

    def noted(df, label):
        own.extend([label] * ("own" in df.columns))
        return stored(df, label)

    monkeypatch.setattr(common, "stored", noted)
    assert {r.component_id for r in jaccard_join.components(docs).collect()} == {0}
    assert not own


def test_block_takes_little_memory():
    texts = pa.array(["some words of a text " * 100] * 2_000)  # 4 MB

    def scan():
        for _, _, data, offsets in common.blocks(texts):
            suffix_dedup.segments(data, offsets)

    assert peak(scan) < 64_000_000


def test_chunks_to_merge_are_small():
    rows = [(h, i, 0, b"x" * 150) for h in range(2_000) for i in range(3)]
    dealt = list(suffix_dedup.chunks(iter(rows)))
    assert [row for held in dealt for row in held] == rows
    assert max(sum(len(row[3]) for row in held) for held in dealt) <= (1 << 16) + 450
    assert all(len({row[0] for row in a} & {row[0] for row in b}) == 0 for a, b in zip(dealt, dealt[1:]))


def test_phrase_sums_are_packed():
    rng = np.random.default_rng(3)
    keys, counts = np.unique(rng.integers(0, 1 << 33, 200_000)), rng.geometric(0.7, 200_000)
    counts = counts[: len(keys)]
    counts[5] = 1 << 40
    batch = phrase_mining.dealt(keys, counts, 7)
    assert batch.num_rows == 7 and batch.nbytes < 4 * len(keys)
    got = phrase_mining.summed([phrase_mining.unpacked(b.as_buffer()) for b in batch.column("block")])
    assert np.array_equal(got[0], keys) and np.array_equal(got[1], counts)
    twice = phrase_mining.summed([(keys, counts), (keys, counts)])
    assert np.array_equal(twice[0], keys) and np.array_equal(twice[1], 2 * counts)
    assert phrase_mining.dealt(keys[:0], counts[:0], 7).num_rows == 0


def test_tries_take_few_bytes_a_node():
    rng = np.random.default_rng(4)
    words = sorted({bytes(x) for x in rng.integers(97, 117, (30_000, 9)).astype(np.uint8)})
    trie = phrase_mining.word_trie([(0, w) for w in words], list(range(len(words))), 1)
    nodes = int((trie.check >= 0).sum())
    assert nodes > 100_000 and trie.size < 2 * nodes
    # nodes with many children beyond the first level, where most slots are taken
    two = np.unique(rng.integers(0, 4_000, (40_000, 2)), axis=0)
    three = [np.stack([np.full(400, at), rng.permutation(4_000)[:400]], 1) for at in range(20)]
    three = np.concatenate([*three, np.unique(np.stack([rng.integers(20, len(two), 20_000), rng.integers(0, 4_000, 20_000)], 1), axis=0)])

    def fill(trie):
        states = trie.add_levels([(two[:, 0], two[:, 1]), (three[:, 0], three[:, 1])])
        trie.index[states[0]], trie.index[states[1]] = np.arange(len(two)), np.arange(len(three))

    trie = phrase_mining.built(4_000, len(two) + len(three), fill)
    assert trie.size < 4 * (len(two) + len(three))
    first = trie.step(two[:, 0], two[:, 1])
    assert np.array_equal(trie.index[first], np.arange(len(two)))
    assert np.array_equal(trie.index[trie.step(first[three[:, 0]], three[:, 1])], np.arange(len(three)))
    assert (trie.step(first[three[:, 0]], (three[:, 1] + 1) % 4_000) >= 0).mean() < 0.2


def test_shared_arrays_are_held_once(spark):
    value = np.arange(1_000_000)
    get = common.share(spark, (value, "x"), views=True)
    assert np.array_equal(get()[0], value) and get()[1] == "x"  # this reads what was sent
    assert peak(get) < 1_000_000
