"""Phrase mining, MinHash near duplicates and whitening against brute force."""

import itertools
import random

import numpy as np
import pytest

from eodscan.llm import common, minhash_dedup, phrase_mining, whitening
from eodscan.llm.queries import QUERIES

from . import brute
from .conftest import odd_vectors, prose
from .test_operators import by_id, ordered

# ---------------------------------------------------------------- phrase mining


def phrase_rows(n=60):
    rng = random.Random(21)
    rows = []
    for i in range(n):
        lang = ["en", "de", None][i % 3]
        words = rng.choices(["the", "Of", "a", "new", "york", "city", "é", "x" * 300], k=rng.randint(0, 60))
        text = "".join(w + rng.choice([" ", " ", "\t ", ". ", "\n", "  "]) for w in words) + " New York City hall"
        rows.append((i, text, lang))
    return rows + [(None, "a a a a a a a", "en"), (None, None, "en"), (7, "", None), (8, " ,.;\r\x0b", "fr"), rows[1], rows[1]]


def mined(spark, rows, top=2000):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 id", "2 nth", "3 entry", "'w' word")
    return sorted(tuple(r) for r in phrase_mining.mine(docs.repartition(3), top).collect())


@pytest.mark.parametrize("way", ["trie", "join", "shuffle", "late shuffle"])
def test_phrase_mining(spark, monkeypatch, way):
    """The tries, and the ways beyond their size."""
    monkeypatch.setattr(phrase_mining, "MIN", 6)
    monkeypatch.setattr(phrase_mining, "HELD", 4)
    monkeypatch.setattr(phrase_mining, "SLICE", 9)
    if way == "join":
        monkeypatch.setattr(phrase_mining, "WORD_BYTES", 5)
    if way == "shuffle":
        monkeypatch.setattr(phrase_mining, "TRIE_NODES", 3)
    if way == "late shuffle":
        monkeypatch.setattr(phrase_mining, "TRIE_NODES", 150)
    rows = phrase_rows()
    want = brute.collocations([(t, lang) for _, t, lang in rows], 6, 5, 20)
    assert mined(spark, rows, 20) == want and len(want) == 60


def test_phrase_mining_is_exact_beyond_64_bits(spark):
    big = 900_000_000_000_000
    vocabulary = spark.createDataFrame([(0, "en", "p", 3 * big + 1), (1, "en", "q", 7 * big + 3)], "id int, lang string, word string, f long")
    frequent = spark.createDataFrame([([0, 1], big)], "ids array<int>, f long")
    totals = spark.createDataFrame([("en", 90 * big)], "lang string, n long")
    row = phrase_mining.scored(frequent, vocabulary, totals).first()
    assert row.score == 1000 * big * 90 * big // ((3 * big + 1) * (7 * big + 3))


def test_double_array_holds_what_was_put_in():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 300, (4000, 2)), axis=0)

    def fill(trie):
        slots = trie.add_level(pairs[:, 0], pairs[:, 1])
        trie.index[slots] = np.arange(len(pairs))

    trie = phrase_mining.built(300, 10, fill)  # too few places at first
    every = np.array(list(itertools.product(range(300), range(300))))
    state = trie.step(every[:, 0], every[:, 1])
    known = {tuple(p): i for i, p in enumerate(pairs)}
    got = np.where(state >= 0, trie.index[state], -1)
    assert got.tolist() == [known.get(tuple(p), -1) for p in every]
    assert (trie.step(np.array([-1, 3]), np.array([2, -1])) == -1).all()


def test_word_numbers_are_exact():
    words = [(0, b"a"), (0, b"ab"), (1, b"ab"), (0, "été".encode()), (1, b"z" * 700)]
    trie = phrase_mining.word_trie(words, [5, 6, 7, 8, 9], 2)
    texts = ["a AB abc a ab. ab a", "ab " + "Z" * 700 + " ab", "été a", "", "a"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = phrase_mining.word_numbers(trie, np.array([0, 1, 0, 0, -1]), data, offsets)
    assert got.tolist() == [5, 6, -1, 5, 6, -1, 6, 5, -1, 7, 9, 7, -1, 8, 5, -1]


# ---------------------------------------------------------------- MinHash


def test_minhash_dedup(spark, odd):
    path, rows, _ = odd
    got = by_id(QUERIES["op12_minhash_dedup"](spark, path))
    for i, (n, component) in brute.components([(i, t) for i, t, _, _ in ordered(rows)], 4, 80).items():
        assert set(got[i]) == {(n, component, i == component)}, i
    assert all(c is None and kept for _, c, kept in got[None])
    assert sum(map(len, got.values())) == len(rows)


def edited_families(families=4, members=30, size=120, most=9):
    rng = random.Random(14)
    docs = []
    for family in range(families):
        base = [f"f{family}w{rng.randint(0, 5000)}" for _ in range(size)]
        for _ in range(members):
            text = list(base)
            for _ in range(rng.randint(0, most)):
                text[rng.randrange(size)] = f"e{rng.randint(0, 10**6)}"
            docs.append((len(docs), " ".join(text)))
    return docs


@pytest.mark.parametrize("family, block", [(1 << 21, 1 << 20), (500, 1 << 20), (500, 700)])
def test_minhash_dedup_of_families(spark, monkeypatch, family, block):
    """Families of edited copies around the threshold: whole, and cut into blocks."""
    monkeypatch.setattr(minhash_dedup, "FAMILY", family)
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    docs = edited_families()
    want = brute.components(docs, 4, 80)
    frame = spark.createDataFrame(docs + docs[:5], "doc_id long, text string").withColumns({"label": common.F.lit(1), "node": common.F.lit(2)})
    got = by_id(minhash_dedup.components(frame.repartition(3)))
    assert {i: v[0][:2] for i, v in got.items()} == want and [len(got[i]) for i in (0, 5)] == [2, 1]
    assert 8 < len({c for _, c in want.values()}) < len(docs) - 8


def test_minhash_dedup_of_shared_ids(spark):
    """Rows that share an id are judged by their own text."""
    one, two = prose(random.Random(1), 60), prose(random.Random(2), 60)
    rows = [(5, one), (5, two), (3, two + " end"), (9, one), (None, one)]
    got = sorted(tuple(r) for r in minhash_dedup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r[0] is not None)
    assert sorted((i, c) for i, _, c, _ in got) == [(3, 3), (5, 3), (5, 5), (9, 5)]


def test_minhashes_estimate_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    both = minhash_dedup.signatures(np.concatenate([a, b]), np.array([0, 1000]))
    assert both.shape == (2, 120) and abs((both[0] == both[1]).mean() - 800 / 1200) < 0.15
    one, other = minhash_dedup.halves(both)
    widths = (both[0] == both[1]).reshape(40, 3).all(axis=1)
    assert ((one == other) == widths).all() and len(set(one.tolist())) == 40


# ---------------------------------------------------------------- whitening


def test_whitening(spark, odd):
    path, _, _ = odd
    rows = QUERIES["op13_whitening"](spark, path).collect()
    kept = [(i, np.float32(v).astype(float)) for i, v in odd_vectors()[:43]]
    x = np.array([np.floor(64 * v).astype(int) + 1_000_000 for _, v in kept])
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    want = centred @ axes[:, :6] / np.sqrt(values[:6])
    assert len(rows) == n * 7 and {r.n for r in rows} == {n}
    signs = {}
    for (i, _), w, own in zip(kept, want, x):
        mine = sorted((r for r in rows if r.vec_id == i), key=lambda r: r.component)[:: 3 if i == 0 else 1]
        assert [r.component for r in mine] == [1, 2, 3, 4, 5, 6, 7] and mine[6].whitened is None
        assert {r.deviation for r in mine} == {int(((n * own - total) ** 2).sum())}
        for r in mine[:6]:
            sign = signs.setdefault(r.component, np.sign(r.whitened * w[r.component - 1]))
            assert abs(sign * r.whitened - w[r.component - 1]) < 1e-9
            assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12
    assert max(r.identity_error for r in rows) < 1e-9 and mine[6].explained == 0


def test_whitening_without_variance(spark):
    rows = [(i, [1.0, float("1e30")]) for i in range(3)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 6 and {tuple(r)[3:] for r in got} == {(0, None, None, None)}


def test_whitening_of_large_deviations(spark):
    """Exact beyond what numpy's integers hold; null beyond a long."""
    rows = [(0, [1e9, 0.5]), (1, [-1e9, 0.25]), (2, [3.0, 0.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = [[int(64 * c) for c in v] for _, v in rows]
    total = [sum(c) for c in zip(*x)]
    want = [sum((3 * c - s) ** 2 for c, s in zip(row, total)) for row in x]
    assert [got[i] for i in range(3)] == [v if v < 2**63 else None for v in want] and got[2] is not None


def test_solver():
    rng = np.random.default_rng(0)
    turned = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    clusters = np.r_[np.full(10, 5.0), np.full(10, 2.0), 1 + 1e-9 * np.arange(10)]
    cases = [np.linalg.qr(rng.standard_normal((5 * d, d)) * np.logspace(0, 3, d), mode="r") for d in (1, 2, 3, 8, 64)]
    cases += [np.eye(9), np.linalg.qr((turned * np.sqrt(clusters)) @ turned.T, mode="r")]
    for r in cases:
        values, axes = whitening.solve(r)
        want = np.linalg.svd(r)[1] ** 2
        assert np.abs(values - want).max() < 1e-13 * want[0]
        assert np.abs(axes.T @ axes - np.eye(len(r))).max() < 1e-12
        assert np.abs(r.T @ (r @ axes) - axes * values).max() < 1e-8 * want[0]
    # small singular values keep their digits, which a covariance matrix would lose
    graded = np.diag(10.0 ** -np.arange(8)) + np.diag(10.0 ** -np.arange(7) * 0.5, 1)
    exact = whitening.squared_singular_values(np.diag(graded), np.diag(graded, 1))
    assert np.allclose(np.prod(exact), np.prod(np.diag(graded)) ** 2, rtol=1e-12)
    singular = np.linalg.qr(rng.standard_normal((50, 3)) @ rng.standard_normal((3, 8)), mode="r")
    assert (whitening.solve(singular)[0][3:] == 0).all()
