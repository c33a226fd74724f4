"""Plain statements of what the operators return, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows, k=5, num=75):
    """{doc_id: (n_shingles, component)} for distinct (doc_id, text)."""
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for at, i in enumerate(ids):
        for j in ids[:at]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= num * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def long_repeats(rows, span=100):
    """{doc_id: (n_bytes, n_removed, n_spans, sha)} for distinct (doc_id, text) in order."""
    seen, out = set(), {}
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - span + 1):
            w = data[s : s + span]
            if w in seen:
                gone[s : s + span] = b"\1" * span
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i] = len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()
    return out


def line_removal(rows, min_sites, min_chars):
    """{doc_id: (n_lines, n_removed, kept)} for distinct (doc_id, text, source) in order of doc_id."""
    sites, first = defaultdict(set), {}
    for i, text, source in rows:
        for at, line in enumerate((text or "").split("\n") if text is not None else []):
            key = line.strip(" ")
            if len(key) >= min_chars:
                sites[key].add(source)
                first.setdefault(key, (i, at))
    out = {}
    for i, text, source in rows:
        lines = text.split("\n") if text is not None else []
        kept = [
            line
            for at, line in enumerate(lines)
            if len(line.strip(" ")) < min_chars or len(sites[line.strip(" ")]) < min_sites or first[line.strip(" ")] == (i, at)
        ]
        out[i] = len(lines), len(lines) - len(kept), "\n".join(kept)
    return out


def contaminated(rows, items, threshold=0.75):
    """Set of (doc_id, item_id)."""
    out = set()
    for i, text in rows:
        w = words(text)
        for item, item_text in items:
            v = words(item_text)
            if not v or len(w) < len(v):
                continue
            k = min(5, len(v))
            span = len(v) - k + 1
            want = Counter(tuple(v[j : j + k]) for j in range(span))
            own = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
            for s in range(len(own) - span + 1):
                got = Counter(own[s : s + span])
                both = sum((want & got).values())
                if both / (2 * span - both) >= threshold:
                    out.add((i, item))
                    break
    return out


def luhn(digits):
    total = 0
    for place, c in enumerate(reversed(digits)):
        value = int(c) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def personal(text):
    """Spans of the base kinds, as four lists."""
    t = text or ""
    find = lambda p: [(m.start(), m.end(), m[0]) for m in re.finditer(p, t)]
    email = find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = [x for x in find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(p) <= 255 for p in x[2].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    card = [x for x in find(r"[0-9]([\x20-]?[0-9])+") if 13 <= len(digits(x[2])) <= 19 and luhn(digits(x[2]))]
    phone = [x for x in find(r"\+[0-9][\x20().0-9-]+[0-9]") if 9 <= len(digits(x[2])) <= 15]
    return [email, ip, card, phone]


def license_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = []
    for label, phrase in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")):
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    places = [i for i, _ in found]
    labels = sorted({label for _, label in found})
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(labels)


def collocations(rows, least, longest, top):
    """Rows (lang, rank, phrase, a, l, r, n, score) for (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    inside = Counter()
    for (lang, p), a in often.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i : i + k]] = max(inside[lang, p[i : i + k]], a)
    out = []
    for lang in n:
        found = []
        for (own, p), a in often.items():
            if own == lang and inside[own, p] < a:
                cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)
