"""Toxicity by maximum-scoring segments over token log-odds with Dirichlet priors, calibrated by extreme-value statistics.

Every word scores its log-odds between toxic and other training texts, under a Dirichlet prior of `prior` texts split as the
labels are, less a margin that makes chance segments short. One linear scan finds all maximal scoring segments. The best scores
of the training texts without the label give lambda and K of the extreme-value distribution, these the chance of every segment and
the evidence of a text from the sum of its best ones; a logistic map on texts, scored as if unlearned, makes it a probability.

Rules for odd input: null and empty texts have no segment and get the score of a text without evidence; labels that are
null or of unknown documents are not learned; repeated texts count once in training; an empty table gives no rows, and
without both labels every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, keep, remainder

TOKEN = re.compile(r"[^\W\d_]+")
FLUSH = 300_000


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, n): in how many texts of each label a word occurs, summed over stretches of a task."""
    seen: Counter = Counter()

    def rows() -> pa.RecordBatch:
        keys = list(seen)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["word", "toxic", "n"])

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen.update([(w, toxic) for w in {*TOKEN.findall(text.lower())}])
            if len(seen) > FLUSH:
                yield rows()
                seen.clear()
    yield rows()


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a row of token scores, in one scan of Ruzzo and Tompa.

    Each open segment points to the nearest one before it whose left sum is smaller, so that a search never passes over a
    segment twice: segments that a search skips have left sums that no later segment can be smaller than.
    """
    low, high, start, end, before = [], [], [], [], []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    for at in np.flatnonzero(scores > 0).tolist():
        a, b, s = sums[at], sums[at + 1], at
        j = len(low) - 1
        while True:
            while j >= 0 and low[j] >= a:
                j = before[j]
            if j < 0 or high[j] >= b:
                break
            a, s = low[j], start[j]  # the segment grows to the left, over all after j
            for x in (low, high, start, end, before):
                del x[j:]
            j -= 1
        low.append(a)
        high.append(b)
        start.append(s)
        end.append(at + 1)
        before.append(j)
    return [(s, e, float(b - a)) for a, b, s, e in zip(low, high, start, end, strict=True)]


def labelled(docs: DataFrame, labels: DataFrame, most: int = 2_000_000) -> DataFrame:
    """docs with their labels(doc_id, toxic); broadcast up to a checked number of rows, so that texts stay where they are."""
    return docs.join(F.broadcast(labels) if labels.count() <= most else labels, "doc_id")


def learn_words(train: DataFrame, prior: float, most_texts: int) -> tuple[dict | None, DataFrame]:
    """Counts of the words of train(doc_id, text, toxic), and the documents that they come from.

    Learned are at most most_texts distinct texts, chosen by hash: the documented bound of the labelled sample, and so of the
    vocabulary. A word of one text alone keeps what the prior says, as it would if that text were held out.
    """
    # the first document of each text; the texts themselves are not shuffled
    once = train.groupBy(F.sha2("text", 256).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    once = keep(once.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxicity-once")
    n = once.count()
    if n > most_texts:
        once = once.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most_texts / n))
    sizes = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None, once
    words = labelled(train.drop("toxic"), once).select("text", "toxic").mapInArrow(count_words, "word string, toxic int, n long")
    y, x = (F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)) for k in (1, 0))
    found = words.groupBy("word").agg(y.alias("y"), x.alias("x")).where("y + x > 1").toPandas()  # bounded by most_texts
    share = sizes[1] / (sizes[0] + sizes[1])
    return {"words": found["word"].tolist(), "y": found["y"].to_numpy(np.float32), "x": found["x"].to_numpy(np.float32), "prior": (prior * share, prior * (1 - share)), "usual": math.log(sizes[1] / sizes[0]), "rate": 1.0, "log_k": 0.0}, once


def token_scores(model: dict, held: int | None = None) -> np.ndarray:
    """Log-odds of every word for toxic texts, less the margin; the last is an unknown word's. held: the label of the text that the
    words are scored for, whose own share is taken off their counts."""
    y, x = model["y"] - (held == 1), model["x"] - (held == 0)
    a, b = model["prior"]
    odds = np.log((np.maximum(y, 0) + a) / (np.maximum(x, 0) + b)) - model["usual"]
    return np.append(odds, 0.0) - model["margin"]


def evidence(scores: list[float], log_n: float) -> float:
    """Minus the log chance of the best of the sums of a text's highest normalised scores; log_n: log K n."""
    best, total = -log_n, 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        total += s - log_n
        if total <= 0:
            break
        best = max(best, total - (r - 1) * math.log(max(1.0, total)) + math.lgamma(r + 1) + math.lgamma(r))
    return best


SPAN = "array<struct<start:int,end:int,score:double,p:double>>"


def measure(docs: DataFrame, model: dict, alpha: float, label: str | None = None) -> DataFrame:
    """doc_id, (label,) n_words, top, x, n_segments, passages of each document: the best segment's score, the evidence, the number
    of segments and those whose chance is at most alpha. With `label`, every text is scored as if it had not been learned."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    more = [label] if label else []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        number = {w: i for i, w in enumerate(m["words"])}
        unknown, rate, log_k = len(number), m["rate"], m["log_k"]
        tables = [token_scores(m, held) for held in ((0, 1) if label else (None,))]
        for batch in batches:
            rows = []
            held = batch.column(2).to_pylist() if label else [0] * batch.num_rows
            for text, kind in zip(batch.column(1).to_pylist(), held, strict=True):
                words = TOKEN.findall(text.lower())
                found = segments(tables[kind][[number.get(w, unknown) for w in words]]) if words else []
                log_n = log_k + math.log(max(1, len(words)))
                chances = [-math.expm1(-math.exp(min(50.0, log_n - rate * s))) for _, _, s in found]
                passages = [{"start": a, "end": b, "score": s, "p": p} for (a, b, s), p in zip(found, chances, strict=True) if p <= alpha]
                rows.append((len(words), max((s for _, _, s in found), default=0.0), evidence([rate * s for _, _, s in found], log_n), len(found), passages))
            kinds = (pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p", pa.float64())])))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(2 + i) for i in range(len(more))), *columns], ["doc_id", *more, "n_words", "top", "x", "n_segments", "passages"])

    rows = documents(docs, *more)
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", *more))
    return rows.mapInArrow(scan, f"{kept}, n_words int, top double, x double, n_segments int, passages {SPAN}")


def extreme_values(n: np.ndarray, s: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """lambda and log K of best scores S over lengths N, P(S > s) = 1 - exp(-K N exp(-lambda s)), from n texts of score s and log N t.

    By quartiles, so that mislabelled texts among them do not count by their size.
    """
    rate, log_k = 1.0, 0.0
    for _ in range(50):  # S - log N / lambda has an extreme value's quartiles
        z = s - t / rate
        order = np.argsort(z, kind="stable")
        below = np.cumsum(n[order]) / n.sum()
        low, middle, high = (float(z[order][min(len(z) - 1, np.searchsorted(below, q))]) for q in (0.25, 0.5, 0.75))
        rate = 0.5 * rate + 0.5 * min(20.0, max(0.05, 1.5725 / max(1e-3, high - low)))
        log_k = rate * middle + math.log(math.log(2))
    return rate, log_k


def logistic(bins: list[tuple[float, int, int]], steps: int = 60) -> tuple[float, float]:
    """Slope and offset of P(toxic | x) from (x, toxic, others), by Newton steps, halved while they do not help, with a weak prior."""
    x, y, n = (np.array(c, float) for c in zip(*bins, strict=True)) if bins else (np.zeros(0),) * 3

    def cost(a: float, b: float) -> float:
        z = a * x + b
        return float((y * np.logaddexp(0, -z) + n * np.logaddexp(0, z)).sum() + 0.005 * (a - 0.5) ** 2 + 0.0005 * b * b)

    a, b = 0.1, -1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        error, w = y - (y + n) * p, (y + n) * p * (1 - p)
        g0, g1 = error.sum() - 0.001 * b, (error * x).sum() - 0.01 * (a - 0.5)
        h00, h01, h11 = w.sum() + 0.001, (w * x).sum(), (w * x * x).sum() + 0.01
        det = h00 * h11 - h01 * h01
        da, db, size = (h00 * g1 - h01 * g0) / det, (h11 * g0 - h01 * g1) / det, 1.0
        while size > 1e-6 and cost(a + size * da, b + size * db) > cost(a, b):
            size /= 2
        if size <= 1e-6:
            break
        a, b = a + size * da, b + size * db
    return max(float(a), 1e-3), float(b)


def score_toxicity(docs: DataFrame, labels: DataFrame, training: Column | None = None, prior: float = 20.0, margin: float = 1.0, alpha: float = 0.01, most_texts: int = 400_000) -> DataFrame:
    """doc_id, score, predicted, n_segments, passages for every document; labels(doc_id, toxic) are learned where `training` holds."""
    known = keep(labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "toxicity-labels")
    train = labelled(documents(docs if training is None else docs.where(training)), known)
    model, once = learn_words(train, prior, most_texts)
    if model is None:
        return documents(docs).select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0).alias("n_segments"), F.array().cast(SPAN).alias("passages"))
    model["margin"] = margin
    learned = labelled(train.drop("toxic"), once)
    grain = [F.round(F.least("top", F.lit(30.0)) * 50).alias("s"), F.round(F.log(F.greatest("n_words", F.lit(1))) * 4).alias("t")]
    clean = measure(learned.where("toxic = 0"), model, alpha, "toxic").groupBy(*grain).count().toPandas()  # 1500 scores times 90 lengths at most
    model["rate"], model["log_k"] = extreme_values(clean["count"].to_numpy(), clean["s"].to_numpy() / 50, clean["t"].to_numpy() / 4)
    cut = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.round("x", 1)))
    bins = measure(learned, model, alpha, "toxic").groupBy(cut.alias("x")).agg(F.sum("toxic").alias("y"), F.sum(1 - F.col("toxic")).alias("n")).collect()  # 801 rows at most
    a, b = logistic([(r["x"], r["y"], r["n"]) for r in bins])
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.col("x") * a + b))))
    return measure(docs, model, alpha).withColumn("score", score).select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_segments", "passages")


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score_toxicity(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "n_segments", F.size("passages").alias("n_passages"))
