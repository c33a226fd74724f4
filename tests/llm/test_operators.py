"""Every operator over a small table of odd cases, against brute force, and over empty tables."""

import hashlib
import zlib
from collections import Counter

import pytest

from eodscan.llm import common, decontaminate, jaccard_join, language_id, license_scan, line_dedup, packing, pii, suffix_dedup, toxicity, winnowing
from eodscan.llm.queries import QUERIES

from . import brute


def ordered(rows):
    """Distinct rows with an id, by id."""
    return sorted({r for r in rows if r[0] is not None}, key=lambda r: r[0])


def by_id(df):
    out = {}
    for r in df.collect():
        row = r.asDict()
        out.setdefault(row.pop("doc_id"), []).append(tuple(row.values()))
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_line_dedup(spark, odd, monkeypatch):
    path, rows, _ = odd
    got = by_id(QUERIES["op1_line_dedup"](spark, path))
    want = brute.line_removal([(i, t, s) for i, t, _, s in ordered(rows)], line_dedup.MIN_SITES, line_dedup.MIN_CHARS)
    for i, expected in want.items():
        assert set(got[i]) == {expected}, i
    assert sum(v[1] for v in want.values()) == 24 - 1
    assert sum(map(len, got.values())) == len(rows)


def test_line_dedup_near_threshold(spark):
    """Sites around the threshold, where estimates need the exact count."""
    rows = [(i, f"line number {k} of them", f"s{i}") for k in range(5, 16) for i in range(100 * k, 100 * k + k)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    cut = {r.doc_id for r in line_dedup.clean(docs, 10).filter("llm_removed > 0").collect()}
    assert cut == {i for i, t, _ in rows if i // 100 >= 10 and i % 100}


def test_suffix_dedup(spark, odd):
    path, rows, _ = odd
    got = by_id(QUERIES["op2_suffix_array_dedup"](spark, path))
    null_first = sorted({(i, t) for i, t, _, _ in rows if i is None and t}) + [(i, t) for i, t, _, _ in ordered(rows)]
    want = brute.long_repeats(null_first)
    for i, expected in want.items():
        if i is not None:
            assert set(got[i]) == {expected}, i
    assert sum(map(len, got.values())) == len(rows)


def different_contexts(n):
    """Texts that share a passage, each within words of its own."""
    import random

    rng = random.Random(6)
    words = lambda k: " ".join(f"{rng.randrange(10**9):x}" for _ in range(k))
    passage = words(40)
    return [f"{words(30)} {passage} {words(30)}" for _ in range(n)]


def test_suffix_dedup_of_repeated_rows(spark):
    """Repeated rows, rows without an id and different texts of one id whose anchors have different contents."""
    texts = different_contexts(9)
    rows = [(i, t) for i, t in enumerate(texts[:4])] + [(7, t) for t in texts[4:6]]
    docs = spark.createDataFrame([*rows, *rows, *[(None, t) for t in [*texts[6:], texts[6]]]], "doc_id long, text string")
    got = {}
    for r in suffix_dedup.removed(docs).collect():
        got.setdefault((r.doc_id, r.n_bytes, r.kept_sha256), []).append(bytes(r.kept_text).decode())
    kept = [t for v in got.values() for t in v]
    whole = {t for t in texts if t in kept}
    assert len(whole) == 1 and whole < set(texts[6:]) and len(kept) == 16
    for t in set(texts) - whole:  # the words around the passage stay
        assert [k for k in kept if t.startswith(k[:150]) and t.endswith(k[-150:]) and len(k) < len(t)], t
    twice = [(i, t) for i, t in rows[:4] for _ in range(2)]
    got = by_id(suffix_dedup.removed(spark.createDataFrame(twice, "doc_id long, text string")).drop("kept_text"))
    assert {i: set(v) for i, v in got.items()} == {i: {v} for i, v in brute.long_repeats(rows[:4]).items()}


def test_suffix_dedup_of_anchors_with_many_contents(spark, monkeypatch):
    """No group of segments to merge has more than MANY of one anchor."""
    monkeypatch.setattr(suffix_dedup, "MANY", 5)
    merged = []
    whole = suffix_dedup.merge
    monkeypatch.setattr(suffix_dedup, "merge", lambda cut: merged.append(cut) or whole(cut))
    texts = different_contexts(40)
    rows = [*enumerate(texts), (90, texts[3][100:330]), (91, texts[5][60:] + texts[5][20:])]
    got = by_id(suffix_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept_text"))
    assert {i: v[0] for i, v in got.items()} == brute.long_repeats(rows)
    assert all(r["count"] <= 5 for r in merged[0].groupBy("h").count().collect())


def test_language_id(spark, odd):
    path, rows, _ = odd
    got = by_id(QUERIES["op3_language_id"](spark, path))
    for i, t, lang, _ in rows:
        (held, pred, score), *_ = got[i]
        assert held == (zlib.crc32(str("" if i is None else i).encode()) % 3 == 1)
        if i is None:
            continue  # two rows
        if not any(c.isalpha() for c in t or ""):
            assert (pred, score) == ("und", 0.0)
        else:
            assert pred in ("en", "de") and 0 <= score <= 1
        if i is not None and i < 25:
            assert pred == lang
    assert sum(map(len, got.values())) == len(rows)


def test_language_counts_are_those_of_a_plain_count():
    texts = ["abcab", "x", "", None, "ab\0cd"]
    plain = Counter(part[j : j + 2] for t in texts for part in (t or "").split("\0") for j in range(len(part) - 1))
    total = 0
    for points, _, _ in language_id.piece_blocks(texts):
        bucket = language_id.gram_buckets(points)[0]
        total += int((bucket < 1 << language_id.BITS).sum())
    assert total == sum(plain.values())


def test_toxicity(spark, odd):
    path, rows, _ = odd
    got = by_id(QUERIES["op4_toxicity"](spark, path))
    for i, t, _, _ in rows:
        held, score, predicted, _ = got[i][0]
        assert held == (zlib.crc32(str("" if i is None else i).encode()) % 4 == 2)
        assert 0 <= score <= 1 and predicted == int(score >= 0.3)
    assert sum(map(len, got.values())) == len(rows)


def test_maximal_segments():
    import itertools

    import numpy as np

    def recursive(x, lo, hi):
        """The definition: the best segment (shortest, then first), then left and right of it."""
        best = max(((sum(x[a:b]), -(b - a), -a) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
        if best[0] <= 0:
            return []
        a, b = -best[2], -best[2] - best[1]
        return recursive(x, lo, a) + [(a, b, best[0])] + recursive(x, b, hi)

    for x in itertools.product([-2, -1, 1, 3], repeat=5):
        got = toxicity.maximal_segments(np.array(x, dtype=np.float64))
        assert sorted(s for _, _, s in got) == sorted(s for _, _, s in recursive(list(x), 0, 5)), x


def test_toxicity_held_out(spark, tmp_path):
    import random

    from .conftest import prose, write_tables

    rng = random.Random(3)
    rows = [(i, prose(rng, 60) + (" idiot vequ" + rng.choice("abcdef") if i % 5 == 0 else ""), "en", "s") for i in range(600)]
    path = write_tables(spark, tmp_path / "t", rows, [])
    held = [r for r in QUERIES["op4_toxicity"](spark, path).filter("held_out").collect()]
    assert all(r.predicted == (r.doc_id % 5 == 0) for r in held)


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    path, rows, _ = odd
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    got = QUERIES["op5_best_fit_packing"](spark, path).collect()
    want, total = Counter(), 0
    for i, t, _, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[i, piece, start, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= -(-total // 2048) + 1


def test_packing_remembers_two_generations_of_words_at_most(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE", 100)
    coder = packing.WordIds(packing.tokenizer_path())
    texts = [" ".join(f"w{chr(97 + n // 26)}{chr(97 + n % 26)}" for n in range(at, at + 10)) for at in range(0, 600, 10)]
    got = list(coder.of(texts))
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    assert got == [packing.packed(tokenizer.encode(t, add_special_tokens=False).ids) + bytes(4) for t in texts]
    held = [known for known in vars(coder).values() if isinstance(known, packing.Known)]
    assert sum(len(known) + len(known.old) for known in held) <= 2 * (100 + 10)
    assert not any(known.old.old for known in held if known.old)


def test_packing_deals_out_repeated_rows(spark, monkeypatch):
    """No group holds much more than its share when half of all rows are one row repeated."""
    monkeypatch.setattr(packing, "place", lambda lengths, sequence: (len(lengths) + 0 * lengths, 0 * lengths))
    rows = [(7, 0, 0, 10, 5)] * 3000 + [(i, 0, 0, 20, i) for i in range(3000)]
    cut = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    sizes = Counter(r.sequence_id for r in packing.pack(cut, group=600).collect())
    assert sum(sizes.values()) == 6000 and max(sizes.values()) < 750


def test_best_two_fit_is_tight():
    import numpy as np

    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 700, 4000)
    bins = packing.pack_lengths(lengths)
    assert Counter(n for b in bins for n in b) == Counter(lengths.tolist())
    assert all(sum(b) <= 2048 for b in bins) and len(bins) <= -(-lengths.sum() // 2048) + 1


def test_license_scan(spark, odd):
    path, rows, _ = odd
    got = by_id(QUERIES["op6_license_scan"](spark, path))
    assert {r[:5] for r in got[None]} == {brute.license_base(t) for i, t, _, _ in rows if i is None}
    for i, t, _, _ in rows:
        if i is not None:
            n, n_base, first, last, base_labels, labels, score = got[i][0]
            assert (n, n_base, first, last, base_labels) == brute.license_base(t), i
            assert set(base_labels.split(",")) - {""} <= set(labels.split(",")) and 0 <= score <= 1
    assert sum(map(len, got.values())) == len(rows)


def test_license_templates(spark):
    grant = license_scan.TEMPLATES["mit"][0]
    edited = grant.replace("free of charge", "without any charge at all")
    rows = [(1, f"some words {grant} more"), (2, edited), (3, "permission is hereby granted to nobody"), (4, grant + " x " + grant)]
    got = by_id(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i][0][5] for i in (1, 2, 3, 4)] == ["mit", "mit", "", "mit"]


def test_license_labels_of_null_and_shared_ids(spark):
    grant = license_scan.TEMPLATES["mit"][0]
    rows = [(None, grant), (None, "nothing at all here in this one"), (None, grant), (5, grant), (5, "other words"), (5, None)]
    got = sorted((r.doc_id or 0, r.labels, r.n_words) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = len(license_scan.template_words(grant))
    assert got == [(0, "", 7), (0, "mit", n), (0, "mit", n), (5, "", 0), (5, "", 2), (5, "mit", n)]


def test_license_labels_are_those_of_plain_voting(spark):
    """Template labels by a plain count of diagonals, on texts cut and edited from templates."""
    import random

    rng = random.Random(2)
    known = license_scan.listed()
    texts = []
    for _ in range(60):
        own = list(rng.choice(known)[3])
        for _ in range(rng.randint(0, 4)):
            own.insert(rng.randrange(len(own)), rng.choice(["other", "word"])) if rng.random() < 0.5 else own.pop(rng.randrange(len(own)))
        cut = rng.randint(0, len(own) // 2)
        texts.append(" ".join(["some", "start", *own[cut:], "end", *rng.choice(known)[3][:6]]))

    def voted(text):
        w, k, labels = license_scan.template_words(text), license_scan.GRAM, set()
        at = {}
        for i in range(len(w) - k + 1):
            at.setdefault(tuple(w[i : i + k]), []).append(i)
        for _, label, need, whole in known:
            votes = {}
            for j in range(len(whole) - k + 1):
                for i in at.get(tuple(whole[j : j + k]), []):
                    votes.setdefault(i - j, []).append((i, j))
            spans, before = [], None
            for diagonal in sorted(votes):
                if before is None or diagonal - before > license_scan.BAND:
                    spans.append([])
                spans[-1] += votes[diagonal]
                before = diagonal
            for span in spans:
                first, end = min(i for i, _ in span), max(i for i, _ in span) + k
                shared = len(set(w[first:end]) & set(whole)) / len(set(whole))
                if len({j for _, j in span}) >= need * (len(whole) - k + 1) and shared >= license_scan.WORDS_SHARED:
                    labels.add(label)
        return labels

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {i: v[0] for i, v in by_id(license_scan.scan(docs)).items()}
    want = [voted(t) | set(filter(None, brute.license_base(t)[4].split(","))) for t in texts]
    assert [set(filter(None, got[i][5].split(","))) for i in range(len(texts))] == want and sum(map(bool, want)) > 20


def test_license_texts_and_notices(spark):
    """Passages from the middle of license texts, and short notices that differ by a word."""
    from pathlib import Path

    def middle(name):
        own = (Path(license_scan.__file__).parent / "licenses" / f"{name}.txt").read_text().split()
        return " ".join(own[len(own) // 2 : len(own) // 2 + 120])

    want = {"apache-2.0": "apache", "gpl-3": "gpl", "gpl-2": "gpl", "lgpl-2.1": "lgpl", "mpl-2.0": "mpl", "bsd-3": "bsd", "isc-1": "isc", "mit-1": "mit"}
    rows = [(f"some words {middle(name)} and more", label) for name, label in want.items()]
    rows += [(f"Licensed under CC {kind.upper()} 4.0.", f"cc-{kind}") for kind in ("by", "by-nc", "by-nc-sa", "by-nc-nd", "by-sa", "by-nd")]
    rows += [("Licensed under CC terms, by 4.0 words", ""), ("See the notice above", "")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = by_id(license_scan.scan(docs))
    for i, (text, label) in enumerate(rows):
        assert label in got[i][0][5].split(","), (text, got[i])
    assert all(got[i][0][5] == label for i, (_, label) in enumerate(rows) if i >= len(want))


def test_decontamination(spark, odd):
    path, rows, items = odd
    got = {(r.doc_id, r.item_id) for r in QUERIES["op7_decontamination"](spark, path).collect()}
    assert got == brute.contaminated([(i, t) for i, t, _, _ in rows], items)
    assert {i for i, _ in got} >= {35, 36}


def test_decontamination_of_edited_items(spark):
    import random

    rng = random.Random(1)
    item = [f"w{rng.randint(0, 400)}" for _ in range(60)]
    docs = []
    for i in range(60):
        text = list(item)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(60)] = "other"
        docs.append((i, " ".join([f"a{rng.randint(0, 99)}" for _ in range(20)] + text + ["end"])))
    benchmark = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    found = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    want = brute.contaminated(docs, [(7, " ".join(item))])
    assert {(r.doc_id, r.item_id) for r in found} == want and 0 < len(want) < 60


def test_jaccard_join(spark, odd):
    path, rows, _ = odd
    got = by_id(QUERIES["op8_jaccard_join"](spark, path))
    for i, expected in brute.components([(i, t) for i, t, _, _ in ordered(rows)]).items():
        assert set(got[i]) == {expected}, i
    assert all(c is None for _, c in got[None])
    assert sum(map(len, got.values())) == len(rows)


def test_prefixes_of_linked_sets_share_enough():
    """The bound by which sets without a partner go, on pairs exactly at the threshold."""
    import random

    rng = random.Random(5)
    for n in [*range(1, 60), 100, 333, 1000]:
        for m in {n, -(-3 * n // 4), (n + -(-3 * n // 4)) // 2}:
            both = -(-3 * (n + m) // 7)  # the fewest common elements of linked sets
            if both > m:
                continue
            pool = rng.sample(range(10**6), n + m - both)
            x, y = sorted(pool[:n]), sorted(pool[n - both :])
            assert len(y) == m and 100 * both >= 75 * len(pool)
            shared = len(set(x[: jaccard_join.prefix_length(n)]) & set(y[: jaccard_join.prefix_length(m)]))
            small = -(-75 * n // 100)
            assert shared >= max(1, -(-5 * small // 100)), (n, m)


def test_chance_shingles_make_no_region(spark):
    """Sets that share one shingle with each of many others, pairs that share enough of rare and of frequent ones together."""
    import itertools

    n, names = 100, iter(range(10**6))
    assert jaccard_join.prefix_length(n) == 30

    def each_pair_shares_one(ids):
        sets = {i: [] for i in ids}
        for i, j in itertools.combinations(ids, 2):
            shared = next(names)
            sets[i].append(shared)
            sets[j].append(shared)
        return sets

    chain = each_pair_shares_one(range(25))
    dense = {100 + i: [10**7 + k for k in range(5)] for i in range(20)}  # more holders than are paired
    pair = {200 + i: [2 * 10**7 + k for k in range(5)] for i in range(2)}
    # one rare shingle in common, and four that many others hold, each with other ones
    mixed = {300 + i: [3 * 10**7, *(4 * 10**7 + k for k in range(4))] for i in range(2)}
    holders = {i: [*own, 4 * 10**7 + k] for k in range(4) for i, own in each_pair_shares_one(range(400 + 10 * k, 409 + 10 * k)).items()}
    posted = [(h, k1, n, False) for sets in (chain, dense, pair, mixed, holders) for k1, own in sets.items() for h in own]
    got = jaccard_join.connected(spark.createDataFrame(posted, "h long, k1 long, n int, hot boolean")).collect()
    regions = {}
    for r in got:
        regions.setdefault(r.region, set()).add(r.k1)
    assert sorted(map(sorted, regions.values())) == [sorted(dense), sorted(pair), sorted(mixed)]


@pytest.mark.parametrize("region, block", [(1 << 21, 1 << 20), (1500, 1 << 20), (400, 900)])
def test_jaccard_join_in_regions(spark, monkeypatch, region, block):
    """Families of edited copies around the threshold: in tasks, split in rounds, and dealt out in blocks."""
    import random

    monkeypatch.setattr(jaccard_join, "REGION", region)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "DIRECT", 8)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 3)
    rng = random.Random(4)
    docs = []
    for family in range(3):
        base = [f"f{family}w{rng.randint(0, 5000)}" for _ in range(120)]
        for _ in range(25):
            text = list(base)
            for _ in range(rng.randint(0, 6)):
                text[rng.randrange(120)] = f"e{rng.randint(0, 10**6)}"
            docs.append((len(docs), " ".join(text)))
    got = by_id(jaccard_join.components(spark.createDataFrame(docs, "doc_id long, text string")))
    want = brute.components(docs)
    assert {i: v[0] for i, v in got.items()} == want
    assert 3 < len({c for _, c in want.values()}) < len(docs)


def test_winnowing(spark, odd):
    path, rows, _ = odd
    got = by_id(QUERIES["op9_winnowing"](spark, path))
    ids = ordered(rows)
    repeated = {i for i, n in Counter(r[0] for r in rows).items() if n > 1}
    prints = {}
    for at, (i, t, _, _) in enumerate(ids):
        t, follower = t or "", ids[(at + 1) % len(ids)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + follower[:cut]
        for n, sha, fingerprint, edited_print, near_edited, near_next in got[i]:
            assert n == len(t) and 0 <= near_edited <= 1 and 0 <= near_next <= 1
            if i not in repeated:
                assert sha == hashlib.sha256(edited.encode()).hexdigest(), i
                assert edited_print == winnowing.written(*winnowing.winnow(edited))
            assert prints.setdefault(t, fingerprint) == fingerprint
    assert sum(map(len, got.values())) == len(rows)


def test_winnowing_of_large_ids(spark):
    """Ids that a double can't hold, over several ranges."""
    import random

    rng = random.Random(8)
    ids = {rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(2500)} | set(range((1 << 63) - 1500, 1 << 63))
    rows = [(i, f"text number {i} of some words") for i in sorted(ids)]
    got = by_id(winnowing.successors(spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string")))
    assert len(got) == len(rows)
    for at, (i, t) in enumerate(rows):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + rows[(at + 1) % len(rows)][1][:cut]
        assert [v[1] for v in got[i]] == [hashlib.sha256(edited.encode()).hexdigest()], i


def test_winnowing_deals_out_rows_without_an_id(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "RANGE_ROWS", 200)
    rows = [(None, "a text without an id")] * 2000 + [(i, f"text {i}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = Counter(r.llm_range for r in winnowing.with_successors(docs).filter("llm_role = 2").select("llm_range").collect())
    assert len(sizes) > 5 and max(sizes.values()) <= 2 * 2000 / len(sizes)
    got = by_id(winnowing.successors(docs))
    assert len(got[None]) == 2000 and len(set(got[None])) == 1 and len(got) == 2001


def test_winnowing_likeness(spark):
    """near_edited and near_next are the Jaccard similarity of the selected hashes."""
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 400))) for _ in range(30)] + ["", "x"]
    got = by_id(winnowing.successors(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    alike = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
    chosen = lambda t: set(winnowing.winnow(t)[0].tolist())
    for i, t in enumerate(texts):
        follower = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 4] + follower[: len(t) // 4]
        assert got[i][0][4:] == (alike(chosen(t), chosen(edited)), alike(chosen(t), chosen(follower)))


def test_winnow_is_the_definition():
    import random

    rng = random.Random(0)
    for n in [0, 1, 5, 12, 13, 47, 48, 200]:
        text = "".join(rng.choice("ab") for _ in range(n))
        hashes, positions = winnowing.winnow(text)
        whole = [int(winnowing.winnow(text[j : j + 12], window=1)[0][0]) for j in range(n - 11)] if n >= 12 else None
        if whole is None:
            assert len(hashes) == (n > 0)
            continue
        window = min(36, len(whole))
        chosen = {min(range(a, a + window), key=lambda j: (whole[j], -j)) for a in range(len(whole) - window + 1)}
        assert positions.tolist() == sorted(chosen) and hashes.tolist() == [whole[j] for j in sorted(chosen)]


def test_pii(spark, odd):
    path, rows, _ = odd
    got = by_id(QUERIES["op10_pii"](spark, path))
    for i, t, _, _ in rows:
        found = brute.personal(t)
        base = ",".join(f"{k}:{a}:{b}" for k, own in zip(pii.KINDS, found) for a, b, _ in own)
        expected = (*map(len, found), hashlib.sha256(base.encode()).hexdigest())
        assert any(row[:5] == expected and row[5].startswith(base) for row in got[i]), i
    assert sum(map(len, got.values())) == len(rows)


def test_pii_sensitive_terms(spark):
    rows = [(i, f"the meeting of day {i} is set, Kontakt: joe{i}@mail.example.com and more of the day") for i in range(8)]
    rows += [(100 + i, "the day of the meeting and nothing else") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.all_spans(docs).collect()}
    text = rows[3][1]
    at = text.index("Kontakt:")
    assert (4, at, at + 8) in spans[3] and len(spans) == 8
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[3] == "the meeting of day 3 is set, [TERM] [EMAIL] and more of the day" and clean[100] == rows[8][1]


def test_pii_terms_anywhere(spark):
    """A term after the entity or far from it counts, and is marked in documents without an entity too."""
    rows = [(i, f"note {i} of the clinic: reach joe{i}@mail.example.com or wait, the Patient of ward {i} is in") for i in range(20)]
    rows += [(100 + i, "note of the day or wait, reach the mail of ward in time for example") for i in range(60)]
    rows += [(200, "nothing here but a (patient), PATIENT"), (None, "ä😀 the patient")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc: [(s.start, s.end) for s in r.spans if s.kind == 4] for r in pii.all_spans(docs).collect()}
    for i, text in rows[:20]:
        assert spans[i] == [(a, a + n) for a, n in ((text.index("clinic:"), 7), (text.index("Patient"), 7))]
    assert spans[200] == [(20, 27), (30, 37)] and spans[None] == [(7, 14)] and len(spans) == 22


def test_pii_terms_behind_punctuation(spark):
    """The words before entities and the words of the corpus are cut by one rule."""
    rows = [(i, f"some words (e-mail: joe{i}@a.example) and \"tel: +1 375 555 43{i:02}\"") for i in range(8)]
    rows += [(100 + i, "some words and e-words") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text, clean = rows[3][1], {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[3] == text.replace("mail:", "[TERM]").replace("tel:", "[TERM]").replace("joe3@a.example", "[EMAIL]").replace("+1 375 555 4303", "[PHONE]")
    assert clean[100] == rows[8][1]


def test_pii_of_a_long_text(spark):
    """Many sensitive terms in one text: places as a plain search gives them, and no slow growth."""
    import time

    rows = [(i, f"the Patient of joe{i}@mail.example.com is in") for i in range(20)] + [(100 + i, "the day is in") for i in range(60)]
    long = "ä Patient of x@y.example " * 30_000
    docs = spark.createDataFrame([*rows, (500, long)], "doc_id long, text string")
    began = time.time()
    spans = {r.doc: [(s.start, s.end) for s in r.spans if s.kind == 4] for r in pii.all_spans(docs).collect()}
    assert spans[500] == [(25 * k + 2, 25 * k + 9) for k in range(30_000)] and time.time() - began < 60
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[500] == "ä [TERM] of [EMAIL] " * 30_000 and clean[101] == rows[21][1]


def test_pii_term_far_before_its_entity(spark):
    rows = [(i, f"some words Kontakt{' ' * 200}joe{i}@mail.example.com") for i in range(8)] + [(100 + i, "some words") for i in range(20)]
    rows += [(200 + i, "Kontakt" + " " * 90) for i in range(3)]
    spans = {r.doc: [(s.start, s.end) for s in r.spans if s.kind == 4] for r in pii.all_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans[3] == [(11, 18)] and spans[200] == [(0, 7)]


def test_words_of_matches_numpy():
    import pyarrow as pa

    texts = ["A b\tC", "", None, " x ", "é É z"]
    for row, own in common.shingle_sets(pa.array(texts), 1):
        assert len(own) == len(set(brute.words(texts[row])))
