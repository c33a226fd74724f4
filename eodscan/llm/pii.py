"""Personal data by pattern, and information-theoretic sanitisation of the terms that give it away; DataFrame only.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers in whole texts. Patterns start only where
a run of their characters starts and never give back what they took, so very long runs cost linear time;
the matches are those of the plain patterns. A match's place is the sum of the lengths before it: the pieces
between matches are rows, and a window per document and kind adds them up.

A term is a word of three letters or more, with a colon or equals sign right after it, outside e-mail addresses; one rule
cuts the words that are counted and the words that are marked. Every distinct term of every document is counted:
in how many documents it stands, in how many of these an entity (a valid match) stands anywhere, and in how many it
stands right before one. The share of documents with the term that hold an entity estimates how strongly the
term discloses one: P(entity | term), and its information log2(P(entity | term) / P(entity)). As every word of
the corpus is a candidate, the lower end of the share's Wilson interval (Z standard deviations) is held against both
thresholds. For a term right before an entity the share of documents in which it stands there is held
against them as it is. Terms of at least MIN_DOCS documents over the thresholds are sensitive: every occurrence,
in whatever document, is a span (kind `term`) and is generalised.

Edge cases: null or empty text has no span. Identical rows each get the same result; rows are told apart by
doc_id (null too) and a hash of the text. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_DOCS = 5
DISCLOSURE = 0.5  # P(entity | term) from which a term is sensitive
BITS = 1.0  # and its information
Z = 3.0  # standard deviations below the share of documents that hold an entity

KINDS = ["email", "ip", "card", "phone", "term"]
PATTERNS = [
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
TERM = r"(?<!\p{L})\p{L}{3,}+[:=]?+"
BEFORE = rf"({TERM})\s++$"


def _maybe(text: Column) -> list[Column]:
    """Cheap tests that every text with a match passes."""
    return [text.contains("@"), text.rlike(r"[0-9]\.[0-9]"), text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), text.contains("+")]


def _valid(kind: Column, found: Column) -> Column:
    part = F.split(found, r"\.")
    small = F.forall(
        part,
        lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255),
    )
    digits = F.regexp_replace(found, "[^0-9]", "")
    card = F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    phone = F.length(digits).between(9, 15)
    return F.when(kind == 0, True).when(kind == 1, small).when(kind == 2, card).otherwise(phone)


def _matches(text: Column) -> list[Column]:
    """Of each pattern a struct (kind, found, gaps), null where the text can't have a match."""
    options = []
    for nth, (pattern, maybe) in enumerate(zip(PATTERNS, _maybe(text))):
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        gaps = F.split(text, pattern, -1)
        options.append(F.when(maybe, F.struct(F.lit(nth).alias("kind"), found.alias("found"), gaps.alias("gaps"))))
    return options


def base_spans(docs: DataFrame) -> DataFrame:
    """doc, th, kind (0 to 3), start, end (code points, end exclusive)."""
    rows = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th"), "text").filter("text is not null")
    each = rows.select("doc", "th", F.explode(F.array(*_matches(F.col("text")))).alias("k")).filter("k is not null and size(k.found) > 0")
    pieces = each.select(
        "doc", "th", F.col("k.kind").alias("kind"), F.col("k.gaps").alias("gaps"), F.posexplode("k.found").alias("nth", "found")
    ).select("doc", "th", "kind", "nth", "found", F.length(F.get("gaps", F.col("nth"))).cast("long").alias("gap"))
    once = pieces.dropDuplicates(["doc", "th", "kind", "nth"])
    so_far = Window.partitionBy("doc", "th", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = once.withColumn("end", F.sum(F.col("gap") + F.length("found")).over(so_far))
    return placed.filter(_valid(F.col("kind"), F.col("found"))).select(
        "doc", "th", "kind", (F.col("end") - F.length("found")).alias("start"), "end"
    )


def _terms(text: Column) -> Column:
    """Distinct terms of a text, in lower case."""
    outside = F.when(text.contains("@"), F.split(text, PATTERNS[0], -1)).otherwise(F.array(text))
    found = F.flatten(F.transform(outside, lambda gap: F.regexp_extract_all(gap, F.lit(TERM), F.lit(0))))
    return F.array_distinct(F.transform(found, F.lower))


def sensitive_terms(docs: DataFrame) -> DataFrame:
    """term, disclosure, bits of the terms over the thresholds."""

    def tails(k: Column) -> Column:
        nth = F.sequence(F.lit(0), F.size(k["found"]) - 1)
        own = F.transform(nth, lambda i: F.when(_valid(k["kind"], F.get(k["found"], i)), F.lower(F.regexp_extract(F.get(k["gaps"], i), BEFORE, 1))))
        return F.when(F.size(k["found"]) > 0, F.filter(own, lambda t: t.isNotNull()))

    rows = docs.select("text", F.array(*_matches(F.col("text"))).alias("k")).select(
        "text", F.flatten(F.filter(F.transform("k", tails), lambda t: t.isNotNull())).alias("tails")
    )
    n_docs, n_with = rows.agg(F.count("*"), F.count_if(F.size("tails") > 0)).first()
    rows = rows.select(_terms(F.col("text")).alias("terms"), (F.size("tails") > 0).alias("has"), F.col("tails").alias("before"))
    each = rows.select("has", "before", F.explode("terms").alias("term"))
    counted = each.groupBy("term").agg(
        F.count("*").alias("n_docs"), F.count_if("has").alias("n_with"), F.count_if(F.array_contains("before", F.col("term"))).alias("n_before")
    )
    n, share = F.col("n_docs"), F.col("n_with") / F.col("n_docs")
    middle = share + Z * Z / (2 * n)
    low = (middle - Z * F.sqrt((share * (1 - share) + Z * Z / (4 * n)) / n)) / (1 + Z * Z / n)
    elsewhere = F.when(F.col("n_with") >= MIN_DOCS, low).otherwise(0.0)
    beside = F.when(F.col("n_before") >= MIN_DOCS, F.col("n_before") / n).otherwise(0.0)
    disclosure = F.greatest(elsewhere, beside)
    bits = F.log2(F.col("disclosure") / (n_with / n_docs if n_with else 1.0))
    known = counted.select("term", disclosure.alias("disclosure")).filter(F.col("disclosure") >= DISCLOSURE)
    return known.withColumn("bits", bits).filter(F.col("bits") >= BITS)


def term_spans(docs: DataFrame, sensitive: DataFrame) -> DataFrame:
    """doc, th, kind, start, end of every occurrence of the sensitive terms."""
    rows = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th"), "text").filter("text is not null")
    each = rows.select("doc", "th", F.explode(_terms(F.col("text"))).alias("term"))
    own = each.join(sensitive.select("term"), "term").groupBy(F.col("doc").alias("own_doc"), F.col("th").alias("own_th"))
    own = own.agg(F.collect_set("term").alias("terms"))
    texts = rows.dropDuplicates(["doc", "th"]).join(own, F.col("doc").eqNullSafe(F.col("own_doc")) & (F.col("th") == F.col("own_th")))

    def pieces(gap: Column, closing: Column) -> Column:
        """(skip, word) of each term of a gap, and what follows the last with the address that closes the gap."""
        found, between = F.regexp_extract_all(gap, F.lit(TERM), F.lit(0)), F.split(gap, TERM, -1)
        return F.zip_with(
            between, found,
            lambda skip, word: F.struct(
                (F.length(skip) + F.when(word.isNull(), closing).otherwise(0)).alias("skip"), F.coalesce(word, F.lit("")).alias("word")
            ),
        )

    text = F.col("text")
    addresses = F.regexp_extract_all(text, F.lit(PATTERNS[0]), F.lit(0))
    split = texts.select("doc", "th", "terms", F.split(text, PATTERNS[0], -1).alias("gaps"), addresses.alias("addresses"))
    flat = F.flatten(F.zip_with("gaps", "addresses", lambda gap, address: pieces(gap, F.coalesce(F.length(address), F.lit(0)))))

    def once(df: DataFrame, name: str, value: Column, *kept: str) -> DataFrame:
        """inline() of one struct: the value is made once a row, whatever uses it"""
        return df.select("doc", "th", *kept, F.inline(F.array(F.struct(value.alias(name)))))

    def size(piece: Column) -> Column:
        return (piece["skip"] + F.length(piece["word"])).cast("long")

    # places are running sums; in runs of about the root of their number, so that no growing array is copied often
    rows = once(split, "flat", flat, "terms")
    step = F.ceil(F.sqrt(F.size("flat"))).cast("int")
    runs = F.transform(F.sequence(F.lit(1), F.size("flat"), step), lambda i: F.slice("flat", i, step))
    rows = once(rows, "runs", runs, "terms")
    zero = F.lit(0).cast("long")
    sums = F.transform("runs", lambda run: F.aggregate(run, zero, lambda total, piece: total + size(piece)))
    none = F.array().cast("array<bigint>")
    starts = F.aggregate(
        sums,
        F.struct(zero.alias("at"), none.alias("out")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"],
    )
    rows = once(rows, "starts", starts, "terms", "runs")
    no_spans = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def mark(acc, piece):
        end = acc["at"] + size(piece)
        more = F.concat(acc["spans"], F.array(F.struct((end - F.length(piece["word"])).alias("start"), end.alias("end"))))
        hit = F.array_contains("terms", F.lower(piece["word"]))
        return F.struct(end.alias("at"), F.when(hit, more).otherwise(acc["spans"]).alias("spans"))

    found = F.flatten(F.zip_with("runs", "starts", lambda run, at: F.aggregate(run, F.struct(at.alias("at"), no_spans.alias("spans")), mark, lambda acc: acc["spans"])))
    return rows.select("doc", "th", F.explode(found).alias("s")).select("doc", "th", F.lit(4).alias("kind"), "s.start", "s.end")


def all_spans(docs: DataFrame) -> DataFrame:
    """doc, th, spans: sorted distinct (kind, start, end) of every text with a span."""
    docs = docs.select("doc_id", "text")
    sensitive = common.stored(sensitive_terms(docs), "terms")
    both = base_spans(docs).unionByName(term_spans(docs, sensitive))
    return both.groupBy("doc", "th").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("spans"))


def _attached(docs: DataFrame, columns: list[str]) -> DataFrame:
    found = all_spans(docs)
    rows = docs.select(*columns, F.xxhash64("text").alias("llm_th"))
    same = F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("llm_th") == F.col("th"))
    return rows.join(found, same, "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"))
    ).drop("doc", "th", "llm_th")


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id, text with every span generalised to its kind in brackets; spans that overlap become one, of the first one's kind."""
    rows = _attached(docs, ["doc_id", "text"]).withColumn("llm_row", F.monotonically_increasing_id())
    rows = common.stored(rows, "attached")
    none = F.size("spans") == 0
    each = rows.filter(~none).select("llm_row", F.explode("spans").alias("s")).select("llm_row", "s.*")
    order = Window.partitionBy("llm_row").orderBy("start", "end", "kind")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = each.withColumn("opens", F.when(F.col("start") < reached, 0).otherwise(1))
    joined = opens.withColumn("group", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = joined.groupBy("llm_row", "group").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", "end", "kind"))["kind"].alias("kind")
    )
    lists = whole.groupBy("llm_row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts"))
    # a text as an array of its characters, so that all slices together cost its length
    texts = rows.filter(~none).select("llm_row", "doc_id", F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)).alias("chars")).join(lists, "llm_row")
    names = F.array(*map(F.lit, KINDS))

    def piece(cut, nth):
        begin = F.when(nth > 0, F.get("cuts", nth - 1)["end"]).otherwise(0)
        between = F.slice("chars", (begin + 1).cast("int"), (cut["start"] - begin).cast("int"))
        return F.concat(F.array_join(between, ""), F.lit("["), F.upper(F.get(names, cut["kind"])), F.lit("]"))

    last = F.element_at("cuts", -1)["end"].cast("int")
    rest = F.array_join(F.slice("chars", last + 1, F.size("chars")), "")
    cleaned = texts.select("doc_id", F.concat(F.array_join(F.transform("cuts", piece), ""), rest).alias("text"))
    return cleaned.unionByName(rows.filter(none).select("doc_id", "text"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: counts and spans of every document."""
    rows = _attached(common.table(spark, sf_dir, "documents"), ["doc_id"])

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(kind).alias(f"n_{name}") for kind, name in enumerate(KINDS[:4])]
    base = F.filter("spans", lambda s: s["kind"] < 4)
    return rows.select(
        "doc_id", *counts, F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans")
    )
