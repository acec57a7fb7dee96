"""Language identification with bit-sliced Bloom filters over character trigrams.

One table of bit masks serves all languages: a slot's bit l says that some trigram of language l hashes there, so the AND
of a trigram's slots names every language that may contain it. The hits of each language over the text, corrected for
its filter's false positives, decide.

Rules for odd input: null text, or text without a letter, is `und` with score 0; so is every text when no labelled text
was learned; ties go to the first language by code point; repeated rows are predicted alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, remainder, slices

GRAM_BITS = 20
SLOT_BITS = 17
LETTER = re.compile(r"[^\W\d_]")


@cache
def letter_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram numbers of texts with a letter in their middle, and the index of each one's text."""
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    known = letter_table()[codes]
    codes = np.where(known, codes, 32).astype(np.uint64)
    middle = np.flatnonzero(known)
    ends = np.cumsum([len(t) for t in lowered])
    a = codes[middle - 1] * np.uint64(0x9E3779B97F4A7C15) + codes[middle]
    a = a * np.uint64(0xC2B2AE3D27D4EB4F) + codes[middle + 1]
    a = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (a >> np.uint64(64 - GRAM_BITS)).astype(np.int64), np.searchsorted(ends, middle, "right")


def slots(gram: np.ndarray, k: int = 3) -> list[np.ndarray]:
    """k places of a trigram number in the mask table."""
    x = gram.astype(np.uint64) + np.uint64(1)
    return [((x * np.uint64(m)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for m in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)[:k]]


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) summed over a task; the arrays are bounded by languages times 2^GRAM_BITS."""
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        order = sorted(range(len(texts)), key=langs.__getitem__)
        langs, texts = [langs[i] for i in order], [texts[i] for i in order]
        for lang in dict.fromkeys(langs):
            own = texts[langs.index(lang) : len(langs) - langs[::-1].index(lang)]
            total = seen.setdefault(lang, np.zeros(1 << GRAM_BITS, np.int64))
            for i, j in slices(own):
                total += np.bincount(grams(own[i:j])[0], minlength=1 << GRAM_BITS)
    for lang, total in seen.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["lang", "gram", "n"])


def learn(labelled: DataFrame, min_rate: float = 2e-5, share: float = 0.3) -> dict:
    """Filters from labelled(lang, text).

    A trigram enters a language's filter if its rate there is at least min_rate and at least `share` of its highest rate
    in any language. Rates of a language add up to 1, so the driver gets at most 1 / min_rate trigrams of each language.
    """
    counts = labelled.mapInArrow(count_grams, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    rates = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("all"))  # one row for each language
    frequent = rates.where(F.col("rate") >= min_rate).groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate")).alias("in"))
    kept = frequent.select("gram", F.explode(F.filter("in", lambda x: x["rate"] >= share * F.col("top"))).alias("x")).select("gram", "x.lang", "x.rate").toPandas()
    langs = sorted(kept["lang"].unique()) if len(kept) else []
    words = max(1, -(-len(langs) // 64))
    masks = np.zeros((words, 1 << SLOT_BITS), np.uint64)
    coverage = np.zeros(len(langs))
    for i, lang in enumerate(langs):
        own = kept[kept["lang"] == lang]
        coverage[i] = own["rate"].sum()
        for at in slots(own["gram"].to_numpy(np.int64)):
            masks[i // 64, at] |= np.uint64(1 << (i % 64))
    fill = np.array([np.mean((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(langs))])
    return {"langs": langs, "masks": masks, "coverage": coverage, "false": fill**3}


def predict_texts(texts: list[str], model: dict) -> tuple[list[str], list[float]]:
    langs, out, scores = model["langs"], [], []
    for i, j in slices(texts):
        gram, owner = grams(texts[i:j])
        n = np.bincount(owner, minlength=j - i).astype(float)
        votes = np.zeros((len(langs), j - i))
        at = slots(gram)
        for w, table in enumerate(model["masks"]):
            mask = table[at[0]] & table[at[1]] & table[at[2]]
            for k in range(64 * w, min(64 * w + 64, len(langs))):
                hit = ((mask >> np.uint64(k % 64)) & np.uint64(1)).astype(float)
                false = model["false"][k]
                votes[k] = np.maximum(0, np.bincount(owner, hit, j - i) - n * false) / (1 - false) / model["coverage"][k]
        if not langs:
            out += ["und"] * (j - i)
            scores += [0.0] * (j - i)
            continue
        total, best = votes.sum(0), votes.argmax(0)
        for d in range(j - i):
            if not LETTER.search(texts[i + d]):
                out.append("und")
                scores.append(0.0)
            else:
                out.append(langs[best[d]])
                scores.append(float(votes[best[d], d] / total[d]) if total[d] else 1 / len(langs))
    return out, scores


def identify(docs: DataFrame, training: Column | None = None, **options) -> DataFrame:
    """doc_id, lang_pred, score of every document.

    Learns from the rows where `training` holds and lang is not null; predictions see the text alone.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = learn((rows.where(training) if training is not None else rows).select("lang", "text"), **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SLOT_BITS and the number of languages

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = predict_texts(batch.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return documents(docs).mapInArrow(predict, f"doc_id {key}, lang_pred string, score double")


def known_texts(texts: list[str], model: dict, sigmas: float = 3.0) -> list[bool]:
    """Whether some language's filter holds more of a text's trigrams than it lets through by chance.

    That is a question to each language alone, so it does not hang on how many languages there are.
    """
    out: list[bool] = []
    for i, j in slices(texts):
        gram, owner = grams(texts[i:j])
        n = np.bincount(owner, minlength=j - i).astype(float)
        at, known = slots(gram), np.zeros(j - i, bool)
        for w, table in enumerate(model["masks"]):
            mask = table[at[0]] & table[at[1]] & table[at[2]]
            for k in range(64 * w, min(64 * w + 64, len(model["langs"]))):
                hits = np.bincount(owner, ((mask >> np.uint64(k % 64)) & np.uint64(1)).astype(float), j - i)
                false = model["false"][k]
                known |= hits > n * false + sigmas * np.sqrt(n * false * (1 - false))
        out += [bool(x) and LETTER.search(t) is not None for x, t in zip(known, texts[i:j], strict=True)]
    return out


def keep_known(docs: DataFrame, **options) -> DataFrame:
    """The documents, with their columns as they are, that are of some language: with a letter, and with more trigrams of a language
    than its filter lets through by chance. Null and empty texts go; equal rows go or stay together."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    shared = docs.sparkSession.sparkContext.broadcast(learn(rows.select("lang", "text"), **options))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(known_texts([t or "" for t in batch.column("text").to_pylist()], shared.value), pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)


def op9(docs: DataFrame) -> DataFrame:
    out = identify(docs, remainder(F.col("doc_id"), 4) != 2)
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
