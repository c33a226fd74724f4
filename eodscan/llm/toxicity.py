"""Toxicity as maximum-scoring segments over token log-odds.

Learning counts, for labelled rows, how many tokens of toxic and of other documents fall into hashed buckets:
one family of buckets for whole words and two for their first bytes, so that unseen forms of a seen stem
have evidence. A token's log-odds come from a chain of Dirichlet priors: the corpus rate is the prior of the
short stem, the short stem that of the long stem, the long stem that of the word. The log-odds lose a
drift so that ordinary text has a negative expectation; then a linear scan finds every maximal
scoring segment (Ruzzo and Tompa). Segment scores are calibrated by the extreme-value distribution of
the best score of harmless texts, K m n e^(-lambda S), whose lambda solves E[e^(lambda s)] = 1; a document's
evidence is the sum of its significant segments' normalised scores, and a logistic curve fitted on the
learning rows turns it into a probability.

Edge cases: null and empty texts have no segment and the score of no evidence. Without any toxic or without
any other labelled row the score is 0. Null labels are not learned; of several labels of one id the largest counts.
Repeated rows each count. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 18  # buckets of each family: 2 ** BITS
STEMS = (4, 6)  # bytes of the short and the long stem
STRENGTH = 4.0  # pseudo-tokens of each prior
DRIFT = 2.0  # taken from every token's log-odds
CAP = 6.0  # log-odds are held within
FAMILIES = len(STEMS) + 1
LEVELS = 400  # bins of evidence for the logistic curve
STEP = 0.25
CUT = 0.3

IS_TOKEN = np.zeros(256, dtype=bool)
IS_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def token_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[families, tokens] bucket numbers, shortest stem first, and where each text's tokens begin."""
    starts, ends = common.word_spans(data, offsets, IS_TOKEN)
    shift = np.uint64(64 - BITS)
    out = np.empty((FAMILIES, len(starts)), dtype=np.int32)
    for nth, size in enumerate((*STEMS, None)):
        stop = ends if size is None else np.minimum(ends, starts + size)
        out[nth] = (common.span_hashes(data, starts, stop) >> shift).astype(np.int32)
    return out, np.searchsorted(starts, offsets)


def count_tokens(labelled: DataFrame) -> DataFrame:
    """(bucket, other, toxic): documents' tokens by bucket, all families in one number, for rows (text, toxic).

    A document counts each bucket once: long texts don't outweigh short ones."""

    def count(batches):
        size = FAMILIES << BITS
        totals = np.zeros((2, size), dtype=np.int64)
        for batch in batches:
            toxic = np.asarray(batch.column("toxic").to_pylist(), dtype=np.int64)
            for first, last, data, offsets in common.blocks(batch.column("text")):
                buckets, bounds = token_buckets(data, offsets)
                doc = np.repeat(np.arange(last - first), np.diff(bounds))
                for nth in range(FAMILIES):
                    once = np.unique((doc.astype(np.int64) << BITS) | buckets[nth])
                    kind = toxic[first + (once >> BITS)]
                    at = (once & ((1 << BITS) - 1)) + (nth << BITS)
                    for label in (0, 1):
                        np.add.at(totals[label], at[kind == label], 1)
        seen = np.flatnonzero(totals.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int32()), pa.array(totals[0, seen]), pa.array(totals[1, seen])],
            names=["bucket", "other", "toxic"],
        )

    counted = labelled.select("text", "toxic").mapInArrow(count, "bucket int, other long, toxic long")
    return counted.groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))


class Model:
    """Counts by bucket and the calibration; of fixed size whatever the corpus."""

    def __init__(self, counts, n_other: int, n_toxic: int):
        self.n = float(n_other), float(n_toxic)
        self.learned = n_other > 0 and n_toxic > 0
        size = FAMILIES << BITS
        self.counts = np.zeros((2, size), dtype=np.float32)
        if self.learned and len(counts):
            at = counts["bucket"].to_numpy()
            self.counts[0, at] = counts["other"].to_numpy()
            self.counts[1, at] = counts["toxic"].to_numpy()
        self.rate = self.n[1] / max(1.0, sum(self.n))
        self.scale, self.offset = 1.0, 0.0  # of the extreme-value law: lambda, ln K
        self.curve = (0.0, 0.0)  # of the logistic: intercept, slope

    def token_scores(self, buckets: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Log-odds of each token by the chain of priors, less the drift.

        own: the label of each token's text if that text was learned; it is left out of the counts."""
        p = np.full(buckets.shape[1], self.rate, dtype=np.float32)
        for f in range(FAMILIES):
            at = buckets[f] + (f << BITS)
            toxic, other = self.counts[1][at], self.counts[0][at]
            if own is not None:
                toxic, other = np.maximum(toxic - own, 0), np.maximum(other - (1 - own), 0)
            p = (toxic + STRENGTH * p) / (toxic + other + STRENGTH)
        base = np.log(self.rate / (1 - self.rate))
        return np.clip(np.log(p / (1 - p)) - base, -CAP, CAP) - DRIFT

    def evidence(self, segments: list[float], n: int) -> float:
        """Sum of the normalised scores lambda S - ln K - ln n of the segments that exceed 0, that is, of
        which a harmless text of this length has at most about one."""
        loss = self.offset + np.log(max(n, 1))
        return float(sum(s for s in (self.scale * x - loss for x in segments) if s > 0))

    def probability(self, evidence: float) -> float:
        if not self.learned:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * evidence, -50, 50))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, end, score) of all maximal scoring segments, in linear time.

    Runs of one sign are summed first: a maximal segment begins and ends with a whole positive run."""
    if not len(scores):
        return []
    positive = scores > 0
    edges = np.flatnonzero(np.diff(positive)) + 1
    heads = np.concatenate([[0], edges])
    sums = np.add.reduceat(scores.astype(np.float64), heads)
    tails = np.concatenate([edges, [len(scores)]])
    kept: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, end
    total = 0.0
    for value, first, end in zip(sums.tolist(), heads.tolist(), tails.tolist()):
        if value <= 0:
            total += value
            continue
        before, after = total, total + value
        total = after
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= before:
                j -= 1
            if j < 0 or kept[j][1] >= after:
                kept.append((before, after, first, end))
                break
            before, first = kept[j][0], kept[j][2]
            del kept[j:]
    return [(first, end, after - before) for before, after, first, end in kept]


def segments_in(column: pa.Array, model: Model, learned: np.ndarray | None = None):
    """(row, tokens, segments) of each text; learned: the labels if these are the rows learned from."""
    for first, last, data, offsets in common.blocks(column):
        buckets, bounds = token_buckets(data, offsets)
        own = None if learned is None else np.repeat(learned[first:last], np.diff(bounds))
        scores = model.token_scores(buckets, own)
        for row in range(first, last):
            a, b = bounds[row - first], bounds[row - first + 1]
            yield row, int(b - a), maximal_segments(scores[a:b])


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the documents to learn from: crc32 of the id modulo 4 is not 2, with a label."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("llm_id")).agg(
        F.max("toxic").cast("int").alias("toxic")
    )
    rows = docs.select("doc_id", "text").filter(common.crc_mod(F.col("doc_id"), 4) != 2)
    # labels grow with the corpus: never broadcast, whatever their size here
    return rows.join(known.hint("merge"), F.col("doc_id") == F.col("llm_id")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = common.stored(labelled_rows(docs, labels), "labelled")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    model = Model(count_tokens(rows).toPandas(), sizes.get(0, 0), sizes.get(1, 0))
    if not model.learned:
        return model
    # token scores of harmless texts, as a histogram; then lambda and K
    spread = _summed(rows, model, _score_histogram)
    grid = np.arange(spread.shape[1]) * 0.05 - CAP - DRIFT
    model.scale = _lambda(spread[0] / max(1.0, spread[0].sum()), grid)
    best = _summed(rows, model, _best_histogram)[0]
    level = np.arange(len(best)) * STEP - 40.0
    # of a Gumbel law the mean lies 0.5772 above its mode, ln K
    model.offset = float((best * level).sum() / max(1.0, best.sum()) - 0.5772)
    model.curve = _logistic(_summed(rows, model, _evidence_histogram))
    return model


def _score_histogram(batch, toxic, model, out):
    for first, last, data, offsets in common.blocks(batch.column("text")):
        buckets, bounds = token_buckets(data, offsets)
        kind = np.repeat(toxic[first:last], np.diff(bounds))
        at = np.round((model.token_scores(buckets, kind) + CAP + DRIFT) / 0.05).astype(np.int64)
        for label in (0, 1):
            np.add.at(out[label], np.clip(at[kind == label], 0, LEVELS - 1), 1)


def _best_histogram(batch, toxic, model, out):
    """lambda S - ln n of each text's best segment."""
    for row, n, found in segments_in(batch.column("text"), model, toxic):
        if found:
            value = model.scale * max(s for _, _, s in found) - np.log(n)
            out[toxic[row], int(np.clip(round((value + 40.0) / STEP), 0, LEVELS - 1))] += 1


def _evidence_histogram(batch, toxic, model, out):
    for row, n, found in segments_in(batch.column("text"), model, toxic):
        value = model.evidence([s for _, _, s in found], n)
        out[toxic[row], int(np.clip(round(value / STEP), 0, LEVELS - 1))] += 1


def _summed(rows: DataFrame, model: Model, measure) -> np.ndarray:
    """[label, LEVELS] histogram over all rows, summed by Spark."""
    shared = common.share(rows.sparkSession, model)

    def run(batches):
        out, model = np.zeros((2, LEVELS), dtype=np.int64), shared()
        for batch in batches:
            measure(batch, np.asarray(batch.column("toxic").to_pylist(), dtype=np.int64), model, out)
        label, level = np.nonzero(out)
        yield pa.RecordBatch.from_arrays(
            [pa.array(label, pa.int32()), pa.array(level, pa.int32()), pa.array(out[label, level])], names=["label", "level", "n"]
        )

    found = rows.select("text", "toxic").mapInArrow(run, "label int, level int, n long")
    total = np.zeros((2, LEVELS))
    for r in found.groupBy("label", "level").agg(F.sum("n").alias("n")).collect():
        total[r["label"], r["level"]] = r["n"]
    return total


def _lambda(share: np.ndarray, grid: np.ndarray) -> float:
    """The positive root of E[e^(lambda s)] = 1; 1 if the mean is not negative or no score is positive."""
    if (share * grid).sum() >= 0 or not share[grid > 0].any():
        return 1.0
    low, high = 1e-6, 1.0
    while (share * np.exp(high * grid)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (share * np.exp(middle * grid)).sum() < 1 else (low, middle)
    return (low + high) / 2


def _logistic(counts: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (not below 0) of P(toxic) by evidence, by Newton steps with a small ridge."""
    x = np.arange(counts.shape[1]) * STEP
    toxic, total = counts[1] + 0.0, counts.sum(axis=0)
    beta = np.array([np.log((toxic.sum() + 1) / (total.sum() - toxic.sum() + 1)), 0.0])
    design = np.stack([np.ones_like(x), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ design, -30, 30)))
        slope = design @ (toxic - total * p) - 1e-3 * beta
        curvature = (design * (total * p * (1 - p))) @ design.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(curvature, slope)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(0.0, beta[1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, evidence, n_segments and the significant segments (first token, end token, score)."""
    shared = common.share(docs.sparkSession, model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = shared()
        span = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            size = batch.num_rows
            scores, evidence, spans = np.zeros(size), np.zeros(size), [[] for _ in range(size)]
            for row, n, found in segments_in(batch.column("text"), model) if model.learned else ():
                evidence[row] = model.evidence([s for _, _, s in found], n)
                scores[row] = model.probability(evidence[row])
                loss = model.offset + np.log(max(n, 1))
                spans[row] = [
                    {"first": a, "end": b, "score": float(model.scale * s - loss)}
                    for a, b, s in found
                    if model.scale * s > loss
                ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores), pa.array(evidence), pa.array(spans, pa.list_(span))],
                names=["doc_id", "score", "evidence", "segments"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, score double, evidence double, segments array<struct<first:bigint,end:bigint,score:double>>"
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op4: doc_id, held_out, score, predicted, n_segments of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        (common.crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"),
        F.size("segments").cast("long").alias("n_segments"),
    )
