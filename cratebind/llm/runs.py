"""Periodic runs of words, found with a suffix automaton whose end-position sets are merged small into large.

A state's words end at an ordered set of positions. Where two sets meet in a state of length k, two neighbours whose distance d
is at most k show a square: the words before them repeat after d words. Each seed is extended to both sides as far as words d apart
are equal, which gives the run. If a run has period q and 2 q words or more, the last two of its ends that are q apart are such
neighbours, so none is missed.

Only stretches that can hold a run go through the automaton. A run of period q and exponent x or more starts (x - 1) q - 2 triples
of words or more in a row that come again within q words, so a triple whose next place is farther away than a share 1 / (x - 1) of
the stretch of repeating triples around it, and two more, is in none. That test is on hashes, which can only let more through.

Rules for odd input: null and empty texts have no words and no runs; very long texts take O(n log n) steps; repeated rows are worked
out each; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, slices

LEAST_EXPONENT, LEAST_LENGTH = 4, 6
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def squares(word: list[int]) -> set[tuple[int, int]]:
    """(start, distance) of squares that cannot be moved to the left, among them one of every maximal run's period."""
    after: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    ends: list[list[int]] = [[]]
    for i, c in enumerate(word):
        new = len(after)
        after.append({})
        length.append(i + 1)
        link.append(0)
        ends.append([-i])  # negative, so that the common case, a place before all others, is put at the end of the list
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(after)
                after.append(after[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                ends.append([])
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    found = set()
    for v in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        u = link[v]
        if u == 0:
            continue
        many, few, k = ends[u], ends[v], length[u]
        ends[v] = []
        if len(many) < len(few):
            many, few = few, many
        for x in few:
            at = bisect_left(many, x)
            if at and x - many[at - 1] <= k:  # the later neighbour ends at -many[at - 1]
                found.add((1 - x - k, x - many[at - 1]))
            if at < len(many) and many[at] - x <= k:
                found.add((1 - many[at] - k, many[at] - x))
            many.insert(at, x)
        ends[u] = many
    return found


def stretches(word: np.ndarray, text: np.ndarray, exponent: int = LEAST_EXPONENT) -> list[tuple[int, int]]:
    """Bounds of the parts of texts, one after the other, that can hold a run of at least this exponent. text: each word's text."""
    if len(word) < 3:
        return []
    a, b, c, t = (x.astype(np.uint64) for x in (word[:-2], word[1:-1], word[2:], text[:-2]))
    triple = ((a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xC2B2AE3D27D4EB4F) + c) * np.uint64(0xD6E8FEB86659FD93) + t * np.uint64(0xA0761D6478BD642F)
    triple ^= triple >> np.uint64(31)
    triple[text[2:] != text[:-2]] = np.arange(np.count_nonzero(text[2:] != text[:-2]), dtype=np.uint64)  # over the end of a text
    order = np.argsort(triple, kind="stable")
    again = triple[order[1:]] == triple[order[:-1]]
    far = np.full(len(triple), np.iinfo(np.int64).max)
    far[order[:-1][again]] = (order[1:] - order[:-1])[again]
    far[text[2:] != text[:-2]] = np.iinfo(np.int64).max
    alive = far < len(word)
    while alive.any():
        edges = np.flatnonzero(np.diff(np.concatenate([[0], alive.view(np.int8), [0]])))
        starts, stops = edges[::2], edges[1::2]
        reach = (stops - starts + 2) // (exponent - 1)
        fits = np.zeros_like(alive)
        at = np.flatnonzero(alive)
        fits[at] = far[at] <= np.repeat(reach, stops - starts)
        if fits[at].all():
            ends = np.searchsorted(text, text[starts], "right")
            return list(zip(starts.tolist(), np.minimum(ends, stops + reach + 2).tolist(), strict=True))
        alive = fits
    return []


def extend(word: list[int], low: int, high: int, start: int, period: int) -> tuple[int, int]:
    """Bounds of the run of a period that holds the square at start, within low and high."""
    end = start + period
    while end < high and word[end] == word[end - period]:
        end += 1
    while start > low and word[start - 1] == word[start - 1 + period]:
        start -= 1
    return start, end


def find_runs(word: list[int], low: int, high: int, parts: list[tuple[int, int]], exponent: int = LEAST_EXPONENT, least: int = LEAST_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of word[low:high] from its parts, by start, then period; starts count from low."""
    periods: dict[tuple[int, int], int] = {}
    for a, b in parts:
        for at, period in squares(word[a:b]):
            start, end = extend(word, low, high, a + at, period)
            if period < periods.get((start, end), high + 1):  # a multiple of the smallest period has the same bounds
                periods[start, end] = period
    return sorted((s - low, e - s, q) for (s, e), q in periods.items() if e - s >= max(least, exponent * q))


class Numbers(dict):
    """Words and their numbers, given when first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def runs_of(texts: list[bytes], exponent: int, least: int) -> Iterator[tuple[list[tuple[int, int, int]], list[bytes]]]:
    """The runs of each text, and its words that no run drops."""
    words = [t.split() for t in texts]  # for bytes these are the six ASCII white-space characters
    numbers, sizes = Numbers(), [len(w) for w in words]
    word = [numbers[x] for w in words for x in w]
    bounds = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    parts: dict[int, list[tuple[int, int]]] = {}
    text = np.repeat(np.arange(len(texts)), sizes)
    for a, b in stretches(np.array(word, np.int64), text, exponent):
        parts.setdefault(int(text[a]), []).append((a, b))
    for i, own in enumerate(words):
        runs = find_runs(word, bounds[i], bounds[i + 1], parts[i], exponent, least) if i in parts else []
        if runs:
            stays = np.ones(len(own), bool)
            for start, length, period in runs:
                stays[start + period : start + length] = False
            own = [own[j] for j in np.flatnonzero(stays).tolist()]
        yield runs, own


def collapse_runs(docs: DataFrame, exponent: int = LEAST_EXPONENT, least: int = LEAST_LENGTH) -> DataFrame:
    """doc_id, runs (start, length, period) of every text, and the text with the first period of each run alone, its words apart by
    one blank. Runs of fewer than 6 words are found from exponent 4 on alone."""
    if exponent < 2 or (exponent < 4 and least < 6):
        raise ValueError("runs need an exponent of 4, or of 2 and 6 words")
    key = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                found = list(runs_of(texts[a:b], exponent, least))
                flat = [r for runs, _ in found for r in runs]
                rows = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], ["start", "length", "period"])
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(runs) for runs, _ in found])]), pa.int32())
                plain = pa.array([b" ".join(own) for _, own in found], pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(offsets, rows), plain], ["doc_id", "runs", "text"])

    return documents(docs).select("doc_id", F.col("text").cast("binary")).mapInArrow(work, f"doc_id {key}, runs {RUNS}, text string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents whose id's crc32 is divisible by 10 repeat a part of their words to the end, as the query's contract says."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g, n = F.floor(h / 10), F.size("w")
    at = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), g.alias("g")).withColumn("a", F.when(n > 0, F.pmod("g", n)).cast("int"))
    period = (F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int")
    there = at.withColumn("p", period)
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    new = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), n - F.col("a"))), " ")
    return there.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(new).alias("text"))


def digest(runs: Column) -> Column:
    lines = F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return F.sha2(F.array_join(lines, ""), 256)


def op11(docs: DataFrame) -> DataFrame:
    found = collapse_runs(with_planted_runs(docs))
    order = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less")))
    best = F.when(F.size("runs") > 0, F.array_max(order))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), digest(F.col("runs")).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.less")
    return rows.select("doc_id", "n_runs", (-F.col("best.before")).alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
