"""Line dedup: lines spread over many sites are boilerplate.

One aggregation per line hash merges HyperLogLog sketches of the sites a line is seen on (combined before
the shuffle, so a line that a third of all rows hold costs one sketch per task). Lines whose estimate lies
within the sketch's error of the threshold get an exact distinct count. Of a boilerplate line the first
occurrence (smallest doc_id, then line number) stays, so content that was merely copied survives once.

A line is compared by its text without blanks (U+0020) at its ends; lines of fewer than MIN_CHARS
characters are never boilerplate.

Edge cases: null text gives 0 lines and an empty kept text in the query, and stays null in the pipeline; a
null source counts as one site of its own (all nulls together); a text with a null doc_id counts for the
spread but loses nothing; repeated rows are the same document (their lines share the place of the first). Extra columns pass through unused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_SITES = 10
MIN_CHARS = 15
SKETCH_LOG2 = 12
ERRORS = 4.0  # standard errors of the sketch that count as near the threshold


def _key(line: Column) -> tuple[Column, Column]:
    """128 bits of a line: two hashes of its trimmed text."""
    trimmed = F.trim(line)
    return F.xxhash64(trimmed), F.xxhash64(F.lit("second"), trimmed)


def lines_of(docs: DataFrame) -> DataFrame:
    """doc, site, at, h1, h2 of every line long enough to count."""
    parts = docs.select(
        F.col("doc_id").alias("doc"),
        F.xxhash64(F.coalesce(F.col("source"), F.lit("\x00"))).alias("site"),
        F.posexplode(F.split("text", "\n", -1)).alias("at", "line"),
    ).filter(F.length(F.trim("line")) >= MIN_CHARS)
    h1, h2 = _key(F.col("line"))
    return parts.select("doc", "site", "at", h1.alias("h1"), h2.alias("h2"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2, first_doc, first_at of the lines on at least min_sites sites."""
    sketched = (
        lines_of(docs)
        .groupBy("h1", "h2")
        .agg(
            F.hll_sketch_agg("site", F.lit(SKETCH_LOG2)).alias("sketch"),
            F.min("site").alias("one"),
            F.max("site").alias("other"),
            F.min("doc").alias("first_doc"),
        )
        # a line on one site needs no estimate
        .filter("one <> other" if min_sites > 1 else "true")
        .select("h1", "h2", "first_doc", F.hll_sketch_estimate("sketch").alias("estimate"))
    )
    error = ERRORS * 1.04 / (1 << SKETCH_LOG2) ** 0.5
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    spread = common.stored(sketched.filter(F.col("estimate") >= low), "lines")
    near = spread.filter(F.col("estimate") <= high)
    exact = (
        lines_of(docs)
        .join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2", "site")
        .agg(F.lit(1).alias("seen"))
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("sites"))
        .filter(F.col("sites") >= min_sites)
    )
    far = spread.filter(F.col("estimate") > high)
    sure = far.select("h1", "h2", "first_doc").unionByName(
        near.join(exact, ["h1", "h2"]).select("h1", "h2", "first_doc")
    )
    return sure


def removed_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc, places (the line numbers to take out) of the documents that lose lines."""
    found = lines_of(docs).filter("doc is not null").join(boilerplate(docs, min_sites), ["h1", "h2"])
    mine = F.col("doc").eqNullSafe(F.col("first_doc"))
    # within the first document only the first occurrence stays
    first = found.filter(mine).groupBy("h1", "h2").agg(F.min("at").alias("first_at"))
    inside = found.filter(mine).join(first, ["h1", "h2"]).filter("at <> first_at")
    return (
        found.filter(~mine)
        .select("doc", "at")
        .unionByName(inside.select("doc", "at"))
        .groupBy("doc")
        .agg(F.collect_set("at").alias("places"))
    )


def clean(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs with text cut, and the columns llm_lines, llm_removed (counts)."""
    places = removed_lines(docs, min_sites).withColumnRenamed("doc", "llm_doc").withColumnRenamed("places", "llm_places")
    joined = docs.join(places, docs["doc_id"].eqNullSafe(places["llm_doc"]), "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("llm_places", i)), "\n")
    cut = F.when(F.col("llm_places").isNull(), F.col("text")).otherwise(kept)
    return (
        joined.withColumn("llm_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)))
        .withColumn("llm_removed", F.coalesce(F.size("llm_places"), F.lit(0)))
        .withColumn("llm_removed", F.when(F.col("llm_removed") < 0, 0).otherwise(F.col("llm_removed")))
        .withColumn("text", cut)
        .drop("llm_doc", "llm_places")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op1: doc_id, n_lines, n_removed, kept_text of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return clean(docs).select(
        "doc_id",
        F.col("llm_lines").cast("long").alias("n_lines"),
        F.col("llm_removed").cast("long").alias("n_removed"),
        F.coalesce("text", F.lit("")).alias("kept_text"),
    )


SQL = f"""
WITH numbered AS (
    SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
), l AS (
    SELECT doc_id, coalesce(source, chr(0)) AS site, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
    FROM numbered
), keyed AS (
    SELECT doc_id, site, pos, trim(line, ' ') AS k FROM l WHERE length(trim(line, ' ')) >= {MIN_CHARS}
), spread AS (
    SELECT k FROM keyed GROUP BY k HAVING count(DISTINCT site) >= {MIN_SITES}
), gone AS (
    SELECT doc_id, pos FROM (
        SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS nth
        FROM keyed SEMI JOIN spread USING (k)
    ) WHERE nth > 1
), cut AS (
    SELECT l.doc_id, count(gone.pos) AS n_removed,
           string_agg(CASE WHEN gone.pos IS NULL THEN line END, chr(10) ORDER BY l.pos) AS kept
    FROM l LEFT JOIN gone USING (doc_id, pos) GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(len(d.lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, coalesce(c.kept, '') AS kept_text
FROM numbered d LEFT JOIN cut c USING (doc_id)
"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents keep their rows and lose boilerplate lines; n_chars follows the text."""
    cut = clean(docs)
    return cut.withColumn(
        "n_chars", F.when(F.col("llm_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    ).select(*[F.col(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
