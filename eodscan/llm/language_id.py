"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 2- and 3-character grams per language are summed by Spark over all labelled rows; the
log-probability matrix (buckets x languages, a few MB at most) is broadcast, and texts are scored in numpy
in blocks. Long texts are cut into pieces of PIECE characters; n-grams do not cross pieces.

Edge cases: null text or a text without a letter gives `und` with score 0; so does a model that learned
from no row. Null lang is never learned. Repeated rows each count. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 14  # buckets per n-gram length: 2 ** BITS
ORDERS = (2, 3)
PIECE = 1 << 17
UNKNOWN = "und"


def piece_blocks(texts: list[str | None], block: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, piece starts, row of each piece) of runs of pieces; each piece ends in a 0."""
    parts, rows, size = [], [], 0
    for row, text in enumerate(texts):
        lowered = (text or "").lower()
        for at in range(0, len(lowered), PIECE):
            parts.append(lowered[at : at + PIECE])
            rows.append(row)
            size += len(parts[-1]) + 1
            if size >= block:
                yield _points(parts, rows)
                parts, rows, size = [], [], 0
    if parts:
        yield _points(parts, rows)


def _points(parts: list[str], rows: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    joined = "\0".join(parts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter((len(x) + 1 for x in parts), dtype=np.int64, count=len(parts))
    return points, np.cumsum(sizes) - sizes, np.array(rows, dtype=np.int64)


def gram_buckets(points: np.ndarray) -> list[np.ndarray]:
    """For each n-gram length the bucket of the gram that starts at each position; the last bucket, which no
    gram has, stands for grams that hold an end mark."""
    out, none = [], len(ORDERS) << BITS
    for nth, order in enumerate(ORDERS):
        n = len(points) - order + 1
        if n <= 0:
            out.append(np.zeros(0, dtype=np.int64))
            continue
        h, bad = np.zeros(n, dtype=np.uint32), np.zeros(n, dtype=bool)
        for j in range(order):
            part = points[j : j + n]
            h = (h ^ part) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            bad |= part == 0
        bucket = (h >> np.uint32(32 - BITS)).astype(np.int64) + (nth << BITS)
        bucket[bad] = none
        out.append(bucket)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def count_grams(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of (lang, text)."""

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            by_lang: dict[str, list] = {}
            for lang, text in zip(langs, texts):
                by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                total = totals.setdefault(lang, np.zeros((len(ORDERS) << BITS) + 1, dtype=np.int64))
                for points, _, _ in piece_blocks(own):
                    for bucket in gram_buckets(points):
                        total += np.bincount(bucket, minlength=len(total))
        for lang, total in totals.items():
            seen = np.flatnonzero(total[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    counted = labelled.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix of log probabilities, [bucket, language]; the last row is all zeros.

    What reaches the driver is bounded by languages x buckets, whatever the corpus.
    """
    counts = count_grams(labelled.filter("lang is not null and text is not null")).toPandas()
    langs = sorted(counts["lang"].unique()) if len(counts) else []
    size = len(ORDERS) << BITS
    total = np.zeros((size + 1, len(langs)))
    if langs:
        where = {lang: i for i, lang in enumerate(langs)}
        total[counts["bucket"].to_numpy(), counts["lang"].map(where).to_numpy()] = counts["n"].to_numpy()
    logs = np.zeros((size + 1, len(langs)), dtype=np.float32)
    for nth in range(len(ORDERS)):
        part = total[nth << BITS : (nth + 1) << BITS] + 0.5
        logs[nth << BITS : (nth + 1) << BITS] = np.log(part / part.sum(axis=0, keepdims=True))
    return langs, logs


def score_texts(texts: list[str | None], langs: list[str], logs: np.ndarray) -> tuple[list[str], list[float]]:
    """Best language and its posterior (equal priors) for each text."""
    sums = np.zeros((len(texts), max(1, len(langs))))
    columns = np.ascontiguousarray(logs.T)
    for points, starts, rows in piece_blocks(texts) if langs else ():
        per_piece = np.zeros((len(starts), len(langs)))
        for bucket in gram_buckets(points):
            for i in range(len(langs)):
                # a trailing 0 keeps the last start valid for reduceat
                values = np.append(columns[i][bucket], np.zeros(len(points) - len(bucket) + 1, np.float32))
                per_piece[:, i] += np.add.reduceat(values, starts, dtype=np.float64)
        np.add.at(sums, rows, per_piece)
    names, scores = [], []
    top = sums.max(axis=1, keepdims=True)
    posterior = np.exp(sums - top)
    posterior /= posterior.sum(axis=1, keepdims=True)
    best = posterior.argmax(axis=1)
    for row, text in enumerate(texts):
        known = bool(langs) and has_letter(text)
        names.append(langs[best[row]] if known else UNKNOWN)
        scores.append(float(posterior[row, best[row]]) if known else 0.0)
    return names, scores


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score of each row of docs (doc_id, text)."""
    shared = common.share(docs.sparkSession, model)

    def run(batches):
        langs, logs = shared()
        for batch in batches:
            names, scores = score_texts(batch.column("text").to_pylist(), langs, logs)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out_fold(docs: DataFrame) -> DataFrame:
    """Rows to learn from: crc32 of the id modulo 3 is not 1."""
    return docs.filter(common.crc_mod(F.col("doc_id"), 3) != 1)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: doc_id, held_out, lang_pred, score of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, fit(held_out_fold(docs)))
    return found.select("doc_id", (common.crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents without a known language (no letter, or no language at even odds) go.

    If no row is labelled, only documents without a letter go.
    """
    langs, logs = fit(held_out_fold(docs))
    shared = common.share(spark, (langs, logs))
    columns = docs.columns
    schema = docs.schema

    def keep(batches):
        names, matrix = shared()
        for batch in batches:
            found, scores = score_texts(batch.column("text").to_pylist(), names, matrix)
            if names:
                mask = [name != UNKNOWN and score >= 0.5 for name, score in zip(found, scores)]
            else:
                mask = [has_letter(text) for text in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(keep, schema).select(*columns)
