"""Phrase collocations of each language, level by level, counted through minimal perfect hashes.

A phrase of k words is a pair of phrases of k - 1 words that overlap, so its key is a pair of slots of the level below, exact in 64
bits, and only pairs of frequent ones need be looked at (Apriori). Of those, mappers list the pairs of their own texts and pairs
that reach the least count in sum are the candidates. A minimal perfect hash gives each candidate a slot; keys are stored by slot
and compared, so that no other pair is taken for it. Mappers count slots with bincount, the arrays are summed as a tree, and a
phrase reads the counts of its parts by their slots.

Words carry a 64-bit hash of language and word, which is checked to be without clashes over the whole vocabulary (another seed is
taken else). What mappers get of a hash is a few blocks of at most BLOCK keys; more candidates take more passes over compact numbers,
never over texts. The arrays of a task are of a pass's size. Batches, row groups and read splits are bounded as well, as a task's share
of a large input is else many times that of a small one. What a pass or a level has kept is deleted as soon as the next has read it, so
that the disk in use does not grow with the number of passes; the last level's phrases are counted without writing their places.

Rules for odd input: null texts are empty, a null language is `und`; words never cross a document or a mark of PUNCTUATION; a
language without frequent phrases has no rows; ties go by count and then by phrase; repeated rows count again; an empty table gives
no rows; further columns are not looked at.
"""

from __future__ import annotations

import pickle
import string
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, forget, keep

#: Marks that end a piece, beside the line ends.
PUNCTUATION = ".,;:!?"
BLOCK = 1 << 20
BLOCKS_A_PASS = 4
CHUNK = 4096
WORDS_A_SLICE = 400_000
KEYS_A_RANGE = 1 << 19
KEYS_A_TASK = 1 << 21
#: Lower-case A-Z, and every end of a piece as one mark.
PLAIN = bytes.maketrans(string.ascii_uppercase.encode() + PUNCTUATION.encode() + b"\n\v\f\r", string.ascii_lowercase.encode() + b"." * 10)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = (keys ^ np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x >> np.uint64(32)


class PerfectHash:
    """Slots 0 to n - 1 of n distinct keys: a key has the first level in whose bit array it was alone, and the rank of its bit."""

    def __init__(self, keys: np.ndarray):
        self.levels, left, placed = [], np.unique(keys), 0
        self.stored = np.zeros(len(left), np.uint64)
        while len(left):
            size = max(64, len(left) + len(left) // 2)
            cell = self.cells(left, size, len(self.levels))
            alone = np.bincount(cell, minlength=size) == 1
            bits = np.packbits(np.pad(alone, (0, -size % 64)), bitorder="little").view(np.uint64)
            before = placed + np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits)
            self.levels.append((size, bits, before))
            mine = alone[cell]
            self.stored[self.rank(bits, before, cell[mine])] = left[mine]
            placed, left = placed + np.count_nonzero(alone), left[~mine]

    @staticmethod
    def cells(keys: np.ndarray, size: int, level: int) -> np.ndarray:
        return (mixed(keys, level) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    @staticmethod
    def rank(bits: np.ndarray, before: np.ndarray, cell: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (cell & 63).astype(np.uint64)) - np.uint64(1)
        return before[cell >> 6] + np.bitwise_count(bits[cell >> 6] & below)

    def __len__(self) -> int:
        return len(self.stored)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The slots of keys; -1 for those that are none of the hash's, as the stored keys tell."""
        slots, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, bits, before) in enumerate(self.levels):
            cell = self.cells(keys[left], size, level)
            there = bits[cell >> 6] >> (cell & 63).astype(np.uint64) & np.uint64(1) > 0
            slots[left[there]] = self.rank(bits, before, cell[there])
            left = left[~there]
        known = np.flatnonzero(slots >= 0)
        slots[known[self.stored[slots[known]] != keys[known]]] = -1
        return slots


class Codes(dict):
    """Words and their codes within a slice, given when first asked for; the mark between pieces has -1."""

    def __init__(self):
        super().__init__({b".": -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self) - 1
        return found


def slice_row(lang: str, parts: list[np.ndarray], codes: Codes) -> pa.RecordBatch:
    code = np.concatenate(parts)
    words = pa.array([w for w in codes if w != b"."], pa.binary()).view(pa.string())
    n = np.bincount(code[code >= 0], minlength=len(words))
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.RecordBatch.from_arrays([pa.array([lang]), one(words), one(pa.array(n, pa.int64())), pa.array([code.astype(np.int32).tobytes()])], ["lang", "words", "n", "codes"])


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a language as slices: their distinct words, how often each occurs, and all places as codes."""
    open_: dict[str, tuple[list[np.ndarray], Codes]] = {}
    held = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parts, codes = open_.setdefault(lang, ([], Codes()))
            words = text.translate(PLAIN).replace(b".", b" . ").split()
            words.append(b".")
            parts.append(np.fromiter(map(codes.__getitem__, words), np.int64, len(words)))
            held += len(words)
            if held >= WORDS_A_SLICE:
                yield from (slice_row(k, *v) for k, v in open_.items())
                open_, held = {}, 0
    yield from (slice_row(k, *v) for k, v in open_.items())


def pairs(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pairs of neighbours that both have a slot, and their places."""
    at = np.flatnonzero((slots[:-1] >= 0) & (slots[1:] >= 0))
    return slots[at].astype(np.uint64) << np.uint64(32) | slots[at + 1].astype(np.uint64), at


def by_range(keys: np.ndarray, n: np.ndarray, ranges: int, least: int) -> pa.RecordBatch:
    """Keys and counts, which matter up to the least one alone, in rows by a range of the keys' hash."""
    own = (mixed(keys, 99) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    edges = np.searchsorted(own[order], np.arange(ranges + 1))
    keys, n = keys[order], np.minimum(n[order], least).astype(np.uint16)
    some = [r for r in range(ranges) if edges[r] < edges[r + 1]]
    high, low = (keys >> np.uint64(32)).astype(np.uint32), keys.astype(np.uint32)
    cut = lambda x: pa.array([x[edges[r] : edges[r + 1]].tobytes() for r in some], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), cut(high), cut(low), cut(n)], ["range", "high", "low", "n"])


def candidates(slices: DataFrame, ranges: int, least: int) -> DataFrame:
    """key: the pairs of neighbouring slots that occur `least` times or more in sum."""

    def list_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0

        def packed() -> tuple[np.ndarray, np.ndarray]:
            keys, sums = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(keys, kind="stable")
            keys, sums = keys[order], sums[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(sums, first)

        for batch in batches:
            for data in batch.column(0):
                keys, n = np.unique(pairs(np.frombuffer(data.as_buffer(), np.int32))[0], return_counts=True)
                found.append((keys, n))
                held += len(keys)
                if held >= KEYS_A_TASK:
                    found = [packed()]
                    held = len(found[0][0])
                    if held >= KEYS_A_TASK // 2:
                        yield by_range(*found[0], ranges, least)
                        found, held = [], 0
        if held:
            yield by_range(*packed(), ranges, least)

    def enough(rows: pa.Table) -> pa.Table:
        high, low, n = (np.frombuffer(b"".join(rows.column(c).to_pylist()), kind) for c, kind in (("high", np.uint32), ("low", np.uint32), ("n", np.uint16)))
        keys = high.astype(np.uint64) << np.uint64(32) | low
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return pa.table({"key": keys[first[np.add.reduceat(n, first) >= least]].view(np.int64)})

    listed = slices.select("slots").mapInArrow(list_pairs, "range long, high binary, low binary, n binary")
    return listed.groupBy("range").applyInArrow(enough, "key long")


class Level:
    """The hash of a level's keys, in blocks: rows (block, size, hash), and where each block's slots begin."""

    def __init__(self, keys: DataFrame):
        spread = keep(keys, "phrase-keys")
        n = -(-spread.count() // BLOCK)

        def build(rows: pa.Table) -> pa.Table:
            found = PerfectHash(rows.column("key").to_numpy().view(np.uint64))
            return pa.table({"block": rows.column("block")[:1], "size": [len(found)], "hash": pa.array([pickle.dumps(found)], pa.binary())})

        placed = spread.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(max(1, n))))
        self.blocks = keep(placed.groupBy("block").applyInArrow(build, "block long, size long, hash binary"), "phrase-hash", large=True)
        forget(spread)
        sizes = {r["block"]: r["size"] for r in self.blocks.select("block", "size").collect()}  # two numbers for each block
        self.base, total = {}, 0
        for block in sorted(sizes):
            self.base[block], total = (total, sizes[block]), total + sizes[block]
        starts = [(block, start) for block, (start, _) in self.base.items()]
        self.passes = [starts[i : i + BLOCKS_A_PASS] for i in range(0, len(starts), BLOCKS_A_PASS)]
        self.sent: list[Broadcast] = []

    def send(self, some: list[tuple[int, int]]) -> list[tuple[int, Broadcast]]:
        """The blocks of a pass, broadcast, each with its first slot."""
        shared = [(start, self.blocks.sparkSession.sparkContext.broadcast(self.blocks.where(F.col("block") == block).first()["hash"])) for block, start in some]
        self.sent += [x for _, x in shared]
        return shared

    def take_back(self) -> None:
        for shared in self.sent:
            shared.destroy()
        self.sent = []

    def forget(self, *kept: DataFrame) -> None:
        """Delete the hash and what else was kept for this level."""
        self.take_back()
        forget(self.blocks, *kept)

    def keys(self) -> DataFrame:
        """slot, key: what is stored by slot."""
        base = {b: start for b, (start, _) in self.base.items()}

        def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found = pickle.loads(data).stored
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found)) + base[block]), pa.array(found.view(np.int64))], ["slot", "key"])

        return self.blocks.select("block", "hash").mapInArrow(stored, "slot long, key long")

    def place(self, rows: DataFrame, words: bool) -> DataFrame:
        """slots: those of this level, for rows of the words' keys and codes, or of pairs of the slots below.

        BLOCKS_A_PASS blocks of BLOCK keys at most are broadcast, and given up after their pass; what a pass has found so far goes with
        the rows to the next, the last leaves the slots alone.
        """
        own = ["keys", "codes"] if words else ["slots"]
        at = rows.select(*own, F.lit(None).cast("binary").alias("found"))
        kinds = "keys array<bigint>, codes binary, found binary" if words else "slots binary, found binary"
        passes = self.passes or [[]]  # no block: no frequent words
        for n, some in enumerate(passes):
            shared, last = self.send(some), n == len(passes) - 1

            def fill(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
                looks = [(start, pickle.loads(x.value)) for start, x in shared]
                for batch in batches:
                    for i in range(batch.num_rows):  # a row at a time: a slice is large
                        source, old = batch.column(0)[i], batch.column("found")[i]
                        if words:
                            keys = source.values.to_numpy(zero_copy_only=False).view(np.uint64)
                            there, size = np.arange(len(keys)), len(keys)
                        else:
                            slots = np.frombuffer(source.as_buffer(), np.int32)
                            keys, there = pairs(slots)
                            size = len(slots)
                        found = np.frombuffer(old.as_buffer(), np.int32).copy() if old.is_valid else np.full(size, -1, np.int32)
                        for start, look in looks:
                            slot = look(keys)
                            found[there[slot >= 0]] = slot[slot >= 0] + start
                        if last:
                            spelled = np.append(found, np.int32(-1))[np.frombuffer(batch.column("codes")[i].as_buffer(), np.int32)] if words else found
                            yield pa.RecordBatch.from_arrays([pa.array([spelled.tobytes()], pa.binary())], ["slots"])
                        else:
                            yield batch.slice(i, 1).set_column(len(own), "found", pa.array([found.tobytes()], pa.binary()))

            before, at = at, keep(at.mapInArrow(fill, "slots binary" if last else kinds), "phrase-slots", "zstd", large=True)
            self.take_back()
            if n:
                forget(before)
        return at

    def counts(self, slices: DataFrame, below: bool = False, fan: int = 32) -> DataFrame:
        """slot, n: how often each slot occurs, from arrays that mappers count and that are summed `fan` at a time.

        slices has the slots of this level or, with `below`, those of the level below, whose pairs are looked up as they are counted.
        """
        out = None
        for some in self.passes:
            start, size = some[0][1], sum(self.base[block][1] for block, _ in some)
            shared = self.send(some) if below else []

            def bincount(batches: Iterator[pa.RecordBatch], start=start, size=size, shared=shared) -> Iterator[pa.RecordBatch]:
                total = np.zeros(size, np.int64)
                looks = [(first - start, pickle.loads(x.value)) for first, x in shared]
                for batch in batches:
                    for data in batch.column(0):
                        slots = np.frombuffer(data.as_buffer(), np.int32)
                        if not below:
                            total += np.bincount(slots[(slots >= start) & (slots < start + size)] - start, minlength=size)
                            continue
                        keys = pairs(slots)[0]
                        for first, look in looks:
                            slot = look(keys)
                            total += np.bincount(slot[slot >= 0] + first, minlength=size)
                part = TaskContext.get().partitionId()
                some = [(i // CHUNK, np.flatnonzero(own), own) for i in range(0, size, CHUNK) if (own := total[i : i + CHUNK]).any()]
                columns = [pa.array([k for k, *_ in some], pa.int64()), pa.array([part] * len(some), pa.int64()), pa.array([at.astype(np.uint16).tobytes() for _, at, _ in some], pa.binary()), pa.array([own[at].tobytes() for _, at, own in some], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "part", "at", "n"])

            def add(key: tuple, rows: pa.Table) -> pa.Table:
                total = np.zeros(CHUNK, np.int64)
                for at, n in zip(rows.column("at").to_pylist(), rows.column("n").to_pylist(), strict=True):
                    total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int64)
                there = np.flatnonzero(total)
                return pa.table({"chunk": [key[0].as_py()], "part": [key[1].as_py()], "at": pa.array([there.astype(np.uint16).tobytes()], pa.binary()), "n": pa.array([total[there].tobytes()], pa.binary())})

            def spell(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for chunk, at, n in zip(*(batch.column(c).to_pylist() for c in ("chunk", "at", "n")), strict=True):
                        slot = np.frombuffer(at, np.uint16).astype(np.int64) + chunk * CHUNK + start
                        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.frombuffer(n, np.int64))], ["slot", "n"])

            kinds = "chunk long, part long, at binary, n binary"
            width, sums = slices.rdd.getNumPartitions(), slices.select("slots").mapInArrow(bincount, kinds)
            while True:
                sums = sums.withColumn("part", F.floor(F.col("part") / fan)).groupBy("chunk", "part").applyInArrow(add, kinds)
                width = -(-width // fan)
                if width <= 1:
                    break
            own = sums.mapInArrow(spell, "slot long, n long")
            out = own if out is None else out.unionByName(own)
        return self.keys().select("slot", F.lit(0).cast("long").alias("n")) if out is None else out  # no keys at all


def keyed(totals: DataFrame) -> tuple[DataFrame, int]:
    """totals(lang, word, n) with the words' key, and the seed under which no two keys are equal."""
    for seed in count():
        words = totals.withColumn("key", F.xxhash64(F.lit(seed), "lang", "word"))
        if not words.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").take(1):
            return words, seed


def score_of(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a^2 / (l r)), exactly, whatever the counts."""
    a, left, right = (c.cast("decimal(19,0)") for c in (a, left, right))
    top, bottom = F.lit(1_000_000).cast("decimal(7,0)") * (a * a), left * right
    return ((top - top % bottom) / bottom).cast("long")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, percent: int = 50, k: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's k best phrases of 2 to `longest` words that occur `least` times or more.

    A phrase goes if one that holds it has at least `percent` percent of its count; a phrase's longer phrases have no more than those
    one word longer, so these decide.
    """
    with bounded(docs.sparkSession):
        return ranked(docs, longest, least, percent, k)


def ranked(docs: DataFrame, longest: int, least: int, percent: int, k: int) -> DataFrame:
    """The same, in the batches that the session is set to."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    slices = keep(texts.mapInArrow(encode, "lang string, words array<string>, n array<bigint>, codes binary"), "phrase-slices", "zstd", large=True)
    totals = keep(slices.select("lang", F.explode(F.arrays_zip("words", "n")).alias("x")).groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.n").alias("n")), "vocabulary")
    words, seed = keyed(totals)
    sizes = keep(words.groupBy("lang").agg(F.sum("n").alias("words")), "languages")
    ranges = max(1, -(-(sizes.agg(F.sum("words")).first()[0] or 0) // KEYS_A_RANGE))
    level = Level(words.where(F.col("n") >= least).select("key"))
    rows = level.place(slices.select(F.transform("words", lambda w: F.xxhash64(F.lit(seed), "lang", w)).alias("keys"), "codes"), True)
    forget(slices)
    none = F.array().cast("array<bigint>")
    below = level.keys().join(level.counts(rows), "slot").join(words.select("key", "lang", F.col("word").alias("phrase")), "key")
    below = keep(below.select("slot", "lang", "phrase", "n", none.alias("heads"), none.alias("tails")), "phrases-1")
    level.forget(totals)
    found, under = [], None
    for size in range(2, longest + 1):
        level = Level(candidates(rows, ranges, least))
        if not level.base:
            level.forget()
            break
        if size < longest:
            before, rows = rows, level.place(rows, False)
            forget(before)
        known = level.keys().join(level.counts(rows, size == longest), "slot")
        known = known.select("slot", "n", F.shiftright("key", 32).alias("first"), F.col("key").bitwiseAND(0xFFFFFFFF).alias("rest"))
        first = below.select(F.col("slot").alias("first"), "lang", F.col("phrase").alias("head"), F.concat("heads", F.array("n")).alias("heads"))
        rest = below.select(F.col("slot").alias("rest"), F.col("phrase").alias("tail"), F.concat("tails", F.array("n")).alias("tails"))
        spoken = F.concat("head", F.lit(" "), F.element_at(F.split("tail", " "), -1))
        here = keep(known.join(first, "first").join(rest, "rest").select("slot", "first", "rest", "lang", spoken.alias("phrase"), "n", "heads", "tails"), f"phrases-{size}")
        level.forget(*([below] if under is None else []))  # longer phrases are part of the result
        if under is not None:
            held = here.select(F.explode(F.array("first", "rest")).alias("slot"), F.col("n").alias("m")).groupBy("slot").agg(F.max("m").alias("most"))
            found.append(under.join(held, "slot", "left").where(F.coalesce(F.col("most") * 100 < F.col("n") * percent, F.lit(True))))
        below = under = here
    forget(rows)
    if under is not None:
        found.append(under)
    cut = F.transform("heads", lambda x, i: F.struct(score_of(F.col("n"), x, F.element_at("tails", F.size("tails") - i)).alias("score"), i.alias("k"), x.alias("l"), F.element_at("tails", F.size("tails") - i).alias("r")))
    scored = None
    for df in found:
        one = df.select("lang", "phrase", F.col("n").alias("a"), F.array_min(cut).alias("cut"))
        scored = one if scored is None else scored.unionByName(one)
    if scored is None:
        scored = below.where(F.lit(False)).select("lang", "phrase", F.col("n").alias("a"), F.array_min(cut).alias("cut"))
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    top = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("words").alias("n"), F.col("cut.score").alias("score"))


def op12(docs: DataFrame) -> DataFrame:
    return collocations(docs)


OP12_SQL = r"""
with t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
p as (select lang, unnest(string_split_regex(x, '[.,;:!?\x0A-\x0D]')) as piece from t),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda y: y <> '') as ws from p),
g as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase from w, (select unnest([1, 2, 3]) as k)),
f as (select lang, k, phrase, count(*) as a, split_part(phrase, ' ', 1) as w1, split_part(phrase, ' ', 2) as w2, split_part(phrase, ' ', 3) as w3 from g group by lang, k, phrase),
s as (select lang, sum(a)::bigint as n from f where k = 1 group by lang),
c as (select * from f where k > 1 and a >= 10),
cuts as (
  select c.lang, c.phrase, c.k, c.a, 1 as cut, l.a as l, r.a as r from c join f l on l.k = 1 and l.lang = c.lang and l.phrase = c.w1
    join f r on r.k = c.k - 1 and r.lang = c.lang and r.phrase = case c.k when 2 then c.w2 else c.w2 || ' ' || c.w3 end
  union all
  select c.lang, c.phrase, c.k, c.a, 2, l.a, r.a from c join f l on l.k = 2 and l.lang = c.lang and l.phrase = c.w1 || ' ' || c.w2
    join f r on r.k = 1 and r.lang = c.lang and r.phrase = c.w3 where c.k = 3),
scored as (select *, ((1000000::hugeint * a * a) // (l::hugeint * r))::bigint as score from cuts),
least_cut as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
held as (select lang, part, max(a) as most from (select lang, unnest([w1 || ' ' || w2, w2 || ' ' || w3]) as part, a from c where k = 3) group by lang, part),
kept as (select x.* from least_cut x left join held h on h.lang = x.lang and h.part = x.phrase and x.k = 2 where h.most is null or 100 * h.most < 50 * x.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint as rank, phrase, a, l, r, n, score
from kept join s using (lang) qualify rank <= 2000
"""
