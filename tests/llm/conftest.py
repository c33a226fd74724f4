import random

import pytest
from pyspark.sql import types as T

LICENSE = "This work is licensed under the GNU General Public License, version 3."
LINE = "Read more of our stories on the front page"


def prose(rng, n, lang="en"):
    parts = {"en": ["the", "an", "of", "ing", "er", "th", "sh"], "de": ["der", "ung", "sch", "und", "ein", "pf", "ä"]}[lang]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


def odd_rows():
    """(doc_id, text, lang, source): every odd case that the operators define."""
    rng = random.Random(5)
    langs = ["de" if i % 3 == 0 else "en" for i in range(25)]
    texts = [prose(rng, rng.randint(20, 120), lang) for lang in langs]
    rows = [(i, t, langs[i], f"s{i % 14}") for i, t in enumerate(texts)]
    item = prose(random.Random(9), 30)
    add = lambda t, lang="en", source="s1": rows.append((len(rows), t, lang, source))
    add(None)
    add("")
    add("   \n\t ")
    add("1234 !!! 99")
    add("\x00 nul \x1c sep   nb   x")
    add("日本語 😀 ẞ İ ǅ é é <|endoftext|> it's")
    add(texts[0])  # an exact copy
    add(texts[1] + " tail words here", None, None)  # near copies
    near = texts[2].split()
    near[3] = "changed"
    add(" ".join(near))
    add("Wort " + texts[3].upper(), "de")
    add(f"start {item} end of it")
    add(f"{item}")
    for i in range(12):
        add(f"{texts[4 + i][:40]}\n{LINE}\n  {LINE} \nshort", source=f"site{i}")
    add(f"x\n{LICENSE}\n{LICENSE} apache license mit license", source="lic")
    add("mail joe.b+x@mail7.example.com, a@b, 1.2.3.4 1.2.3.400 0001.2.3.4.5 +1 (375) 555-4393. 4539 1488 0343 6467 +123")
    add("4539148803436467 x+y@a.b.c_d@e.f " + "9" * 40 + " " + "a" * 500 + "@ " + "1.2.3")
    add("idiot moron scum " * 3 + texts[20])
    add(("word " * 7 + "\n") * 3000)  # long and repetitive
    add("ab" * 150)
    add(texts[5] + texts[6] + texts[5])
    rows += [rows[0], rows[0], rows[30]]  # repeated rows
    rows.append((None, texts[7], "en", "s1"))
    rows.append((None, None, None, None))
    return rows, [(1, item), (2, ""), (3, None), (4, "one two three"), (5, item)]


def odd_vectors():
    """(vec_id, vector): usable ones, repeated ones, and every kind that is dropped."""
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(6)] + [0.25]) for i in range(40)]
    bad = [None, [], [1.0, 2.0], [None] * 7, [float("nan")] + [0.0] * 6, [float("inf")] * 7, [0.0] * 6 + [float("-inf")]]
    return rows + [rows[0], rows[0], (None, rows[1][1])] + [(100 + i, v) for i, v in enumerate(bad)]


DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # extra columns whose names the operators use themselves
    *[T.StructField(c, T.LongType()) for c in ("doc", "h", "n", "at", "label", "score", "spans", "site", "line")],
])


def write_tables(spark, path, rows, items):
    full = [(i, t, lang, s, None if t is None else len(t), *[7] * 9) for i, t, lang, s in rows]
    spark.createDataFrame(full, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int("idiot" in (t or ""))) for i, t, _, _ in rows if i is not None and i % 3]
    labels += [(3, None, None), (4, 0, None), (None, 1, 1)] if rows else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    vectors = odd_vectors() if rows else []
    kind = "vec_id long, embedding array<float>, label int, v string, component int, n long, task long"
    spark.createDataFrame([(*r, None, "x", 1, 2, 3) for r in vectors], kind).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """(folder, rows, items) of the odd tables."""
    rows, items = odd_rows()
    return write_tables(spark, tmp_path_factory.mktemp("odd"), rows, items), rows, items


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write_tables(spark, tmp_path_factory.mktemp("empty"), [], [])
