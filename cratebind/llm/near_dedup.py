"""Near-duplicate classes by Order MinHash and banded alignment.

A text is the sequence of its words. Every run of three words is labelled with its occurrence number; each of several hash
functions keeps the two smallest labelled runs in text order, so a sketch value agrees when content and order agree. Short
texts have values of their own: the smallest labelled run of two words under each of several hash functions.
All texts that share a value are candidates, and a banded alignment of their words decides: similarity is 1 minus the edit
distance over the longer length, and 0.8 or more links two texts. Classes are the connected components. Pairs of texts that
are of one component already are not aligned, nor are those whose lengths or word counts rule out 0.8.

Rules for odd input: null texts and texts without words are alone in their class, unless they are repeated exactly; texts
of fewer words than a run are one run; null and empty texts are two classes; equal texts are always of one class, also under one doc_id; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, documents, keep, scratch, spread_join

RUN = 3
SHORT_RUN = 2
SHORT = 64  #: texts of up to so many words have the values of short texts
LONG = 50  #: texts of at least so many words have the others; at most 0.8 * (SHORT + 1), so that similar texts share a kind
CELLS = 64
MOST_CELLS = 8192
BLOCK = 1024
BIG = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def labelled_runs(words: np.ndarray, size: int = RUN) -> np.ndarray:
    """A number for each run of `size` words and its occurrence in the text."""
    n = max(1, len(words) - size + 1)
    runs = np.zeros(n, np.uint64)
    for i in range(min(size, len(words))):
        runs = runs * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    runs = mix(runs)
    order = np.argsort(runs, kind="stable")
    new = np.ones(n, bool)
    new[1:] = runs[order][1:] != runs[order][:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    nth = np.empty(n, np.uint64)
    nth[order] = (np.arange(n) - first).astype(np.uint64)
    return mix(runs + nth * np.uint64(0xA0761D6478BD642F))  # also where no run is repeated: a near copy may repeat one


def order_sketch(words: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One value for each seed: the two smallest labelled runs under its hash, in text order."""
    runs = labelled_runs(words)
    out = []
    step = max(1, 2_000_000 // len(runs))
    for i in range(0, len(seeds), step):
        hashed = mix(runs[None, :] ^ seeds[i : i + step, None])
        rows = np.arange(len(hashed))
        first = hashed.argmin(1)
        hashed[rows, first] = BIG
        second = hashed.argmin(1)
        a, b = np.minimum(first, second), np.maximum(first, second)
        out.append(mix(mix(runs[a] ^ seeds[i : i + step]) * np.uint64(3) + runs[b]))
    return mix(np.concatenate(out) ^ seeds)


def short_sketch(words: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One value for each seed: the smallest labelled run of two words under its hash."""
    runs = labelled_runs(words, SHORT_RUN)
    return mix(mix(runs[None, :] ^ seeds[:, None]).min(1) ^ ~seeds)


def sketch(words: np.ndarray, seeds: np.ndarray, short_seeds: np.ndarray) -> list[int] | None:
    """The values of a text; those of different seeds never meet, so that a value alone is a key."""
    if not len(words):
        return None
    parts = [short_sketch(words, short_seeds)] if len(words) <= SHORT else []
    if len(words) >= LONG:
        parts.append(order_sketch(words, seeds))
    return np.concatenate(parts).astype(np.int64).tolist()


def cell_counts(words: np.ndarray) -> bytes:
    """How many words are in each cell, packed; a power of two of cells, at least CELLS and, up to MOST_CELLS, twice the words.

    An edit adds one to a cell at most and takes one from a cell at most; that holds too for counts cut at 255 and folded.
    """
    size = min(MOST_CELLS, max(CELLS, 1 << (2 * len(words) - 1).bit_length())) if len(words) else CELLS
    n = np.bincount((words % np.uint64(size)).astype(np.int64), minlength=size)
    return zlib.compress(np.minimum(n, 255).astype(np.uint8).tobytes(), 1)


def unpacked(cells: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(cells), np.uint8)


def folded(cells: np.ndarray, size: int) -> np.ndarray:
    return cells if len(cells) == size else np.minimum(cells.reshape(-1, size).sum(0, dtype=np.int32), 255).astype(np.uint8)


class Counts:
    """The word counts of many texts, at each number of cells that some text has; finer ones are folded to it."""

    def __init__(self, cells: list[bytes]):
        whole = [unpacked(c) for c in cells]
        self.size = np.array([len(c) for c in whole])
        self.levels = {}
        for size in np.unique(self.size).tolist():
            rows = np.flatnonzero(self.size >= size)
            place = np.full(len(whole), -1)
            place[rows] = np.arange(len(rows))
            counts = np.stack([folded(whole[r], size) for r in rows])
            self.levels[size] = place, counts, counts.sum(1, dtype=np.int32)

    def least_edits(self, i: int, others: np.ndarray) -> np.ndarray:
        """How many edits text i and each of the others need at least: what the longer has and both do not share."""
        low = np.minimum(self.size[i], self.size[others])
        out = np.zeros(len(others), np.int64)
        for size in np.unique(low).tolist():
            place, counts, total = self.levels[size]
            at = np.flatnonzero(low == size)
            rows, own = place[others[at]], place[i]
            shared = np.minimum(counts[rows], counts[own]).sum(1, dtype=np.int32)
            out[at] = np.maximum(total[rows], total[own]) - shared
        return out


def banded_distance(a: list[int], b: list[int], k: int) -> int:
    """Edit distance of two sequences if at most k, else some number above k; only cells within k of the diagonal count."""
    if abs(len(a) - len(b)) > k:
        return k + 1
    start, stop = 0, 0
    limit = min(len(a), len(b))
    while start < limit and a[start] == b[start]:
        start += 1
    while stop < limit - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    a, b = a[start : len(a) - stop], b[start : len(b) - stop]
    if not a or not b:
        return len(a) + len(b)
    if len(a) < len(b):
        a, b = b, a
    k = min(k, len(a))
    at: dict[int, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    if len(a) <= 2 * k + 1:  # the band is no narrower than the whole
        full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
        vp, vn, d = full, 0, len(a)
        for j, w in enumerate(b):
            eq = at.get(w, 0)
            x = eq | vn
            h = (((eq & vp) + vp) ^ vp) | eq
            hp, hn = vn | ~(h | vp) & full, vp & h
            if hp & top:
                d += 1
            elif hn & top:
                d -= 1
            if d - (len(b) - 1 - j) > k:
                return k + 1
            hp, hn = (hp << 1 | 1) & full, hn << 1 & full
            vp, vn = hn | ~(x | hp) & full, hp & x
        return d
    width = 2 * k + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    vp, vn, d = full ^ ((1 << k) - 1), 0, k
    edge = top >> 1
    for j, w in enumerate(b):
        eq = at.get(w, 0)
        shift = j - k
        eq = (eq >> shift if shift >= 0 else eq << -shift) & full
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        if j + k < len(a):
            if not d0 & top:
                d += 1
            if d > k + len(b) - (len(a) - k):
                return k + 1
        else:
            if hp & edge:
                d += 1
            elif hn & edge:
                d -= 1
            edge >>= 1
        vp, vn = (hn | ~((d0 >> 1) | hp)) & full, (d0 >> 1) & hp
    return d


def similar(a: str, b: str, least: float) -> bool:
    x, y = [crc32(w) for w in a.encode().split()], [crc32(w) for w in b.encode().split()]
    longer = max(len(x), len(y))
    k = int((1 - least) * longer + 1e-9)
    return banded_distance(x, y, k) <= k if longer else False


def sketches(docs: DataFrame, values: int, short_values: int) -> DataFrame:
    """node (digest of the text), its sketch, number of words and cell counts; no text is shuffled for it."""
    seeds, short_seeds = (mix(np.arange(i, i + n, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) for i, n in ((1, values), (1 << 20, short_values)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.array([crc32(w) for w in t.encode().split()], np.uint64) for t in batch.column(1).to_pylist()]
            found = [sketch(w, seeds, short_seeds) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64())), pa.array([len(w) for w in words], pa.int32()), pa.array([cell_counts(w) for w in words], pa.binary())], ["node", "sketch", "n_words", "cells"])

    rows = documents(docs).select(node_of("text").alias("node"), "text")
    return rows.mapInArrow(work, "node binary, sketch array<long>, n_words int, cells binary")


def node_of(column: str):
    return F.unhex(F.md5(F.coalesce(F.col(column), F.lit(""))))


def bucket_members(nodes: DataFrame) -> DataFrame:
    """(node, value, n) of every value that n > 1 nodes share."""
    values = nodes.select("node", F.explode(F.array_distinct("sketch")).alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    return keep(values.join(shared, "value").select("node", "value", "n"), "near-members")


def leader_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of each node with the first and last node of every bucket it is in: a cheap first pass, 2 n pairs a bucket."""
    ends = members.groupBy("value").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    # of a large bucket one leader does: what it leaves open is met afterwards
    last = F.when(F.col("n") > 32, F.col("first")).otherwise(F.col("last"))
    both = members.join(ends, "value").select("node", F.explode(F.array("first", last)).alias("leader")).where(F.col("node") != F.col("leader"))
    return both.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def possible(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b), which are stored, that lengths and word counts do not rule out."""
    facts = nodes.select("node", F.struct("n_words", "cells").alias("fact"))
    left = spread_join(pairs, facts.select(F.col("node").alias("a"), F.col("fact").alias("fa")), "a", "b")
    both = spread_join(keep(left, "near-facts"), facts.select(F.col("node").alias("b"), F.col("fact").alias("fb")), "b", "a")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for m, n, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                most = int((1 - least) * max(m, n) + 1e-9)
                good.append(abs(m - n) <= most and Counts([x, y]).least_edits(0, np.array([1]))[0] <= most)
            keeps = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keeps), batch.column(1).filter(keeps)], ["a", "b"])

    return both.select("a", "b", "fa.n_words", F.col("fb.n_words").alias("m_words"), "fa.cells", F.col("fb.cells").alias("other_cells")).mapInArrow(work, "a binary, b binary")


def earlier_values(sketches: list[list[int]], n_words: np.ndarray, value: int) -> np.ndarray:
    """The values of each text below `value`, those of one seed in one column; `value` stands where there is none."""
    width = max(map(len, sketches))
    out = np.full((len(sketches), 2 * width), value, np.int64)
    for row, found, n in zip(out, sketches, n_words, strict=True):
        if n <= SHORT:  # values of short texts begin a sketch, the others end it
            row[: len(found)] = found
        if n >= LONG:
            row[-len(found) :] = found
    return np.minimum(out, value)


def open_pairs(members: DataFrame, nodes: DataFrame, roots: DataFrame, least: float, nearest: bool, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of nodes that share a bucket, are of different components and may be similar by length and word counts.

    A pair belongs to the bucket of the smallest value that both share, and is looked at there alone. With `nearest`, each
    node of a block of a bucket has only its nearest such node of each block. The nodes outside a bucket's largest component are
    cut into blocks of about `block` and meet each other and the blocks of the largest one, whose nodes do not meet among
    themselves; every two blocks that meet are a group of their own, in any task.
    """
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = placed.groupBy("value", "root").agg(F.count("*").alias("m"))
    bucket = sizes.groupBy("value").agg(F.max(F.struct("m", "root")).alias("x"), F.count("*").alias("parts"), F.sum("m").alias("all")).where("parts > 1")
    many = lambda n: F.ceil(n / block).cast("int")
    left = bucket.select("value", F.col("x.root").alias("largest"), many(F.col("all") - F.col("x.m")).alias("few"), many(F.col("x.m")).alias("more"))
    rows = placed.join(left, "value")
    inside = F.col("root") == F.col("largest")
    own = F.when(inside, F.col("few") + F.pmod(F.xxhash64("node"), F.col("more"))).otherwise(F.pmod(F.xxhash64("node"), F.col("few"))).cast("int")
    rows = rows.withColumn("own", own).join(nodes.select("node", "n_words", "cells", "sketch"), "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("few")).otherwise(F.col("few") + F.col("more")) - 1)))
    rows = rows.select("value", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "root", "n_words", "cells", "sketch")
    dealt = rows.repartition("value", "low", "high").sortWithinPartitions("value", "low", "high")

    def meet(group: pa.Table) -> tuple[list[bytes], list[bytes]]:
        node, root, own = group.column("node").to_pylist(), group.column("root").to_pylist(), group.column("own").to_numpy()
        number: dict[bytes, int] = {}
        of = np.array([number.setdefault(r, len(number)) for r in root])
        first, second = [], []
        if len(number) < 2:
            return first, second
        size = group.column("n_words").to_numpy()
        value = group.column("value")[0].as_py()
        earlier = earlier_values(group.column("sketch").to_pylist(), size, value)
        counts = Counts(group.column("cells").to_pylist())
        same = group.column("low")[0] == group.column("high")[0]
        lower = own == group.column("low")[0].as_py()
        for i in range(len(node)):
            fit = of != of[i]
            if not same:
                fit &= lower != lower[i]
            if not nearest:  # each pair once
                fit[: i + 1] = False
            most = ((1 - least) * np.maximum(size, size[i]) + 1e-9).astype(np.int64)
            at = np.flatnonzero(fit & (np.abs(size - size[i]) <= most))
            at = at[~((earlier[at] == earlier[i]) & (earlier[i] < value)).any(1)]  # they met, or meet, at an earlier value
            if not len(at):
                continue
            bound = counts.least_edits(i, at)
            good = bound <= most[at]
            at, bound = at[good], bound[good]
            if nearest and len(at):
                at = at[[bound.argmin()]]
            for j in at:
                first.append(min(node[i], node[j]))
                second.append(max(node[i], node[j]))
        return first, second

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(table: pa.Table, final: bool) -> tuple[list[int], int]:
            keys = [table.column(i).to_numpy() for i in range(3)]
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], 0)) + 1
            starts = [0, *cut.tolist()]
            return starts + ([table.num_rows] if final else []), starts[-1]

        def pairs(table: pa.Table, starts: list[int]) -> Iterator[pa.RecordBatch]:
            a, b = [], []
            for i, j in zip(starts, starts[1:]):
                x, y = meet(table.slice(i, j - i))
                a += x
                b += y
                if len(a) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
                    a, b = [], []
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            starts, rest = groups(table, False)
            yield from pairs(table, starts)
            held = table.slice(rest).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from pairs(table, groups(table, True)[0])

    return dealt.mapInArrow(work, "a binary, b binary").distinct()


def packed_texts(texts: DataFrame) -> DataFrame:
    """node, text of the rows with the text compressed, as it crosses several shuffles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [zlib.compress(t.encode(), 1) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["node", "text"])

    return texts.select("node", "text").mapInArrow(work, "node binary, text binary")


def verified(pairs: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """The pairs, which are stored, whose texts are similar."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = documents(docs).select(node_of("text").alias("node"), "text").join(named, "node", "left_semi")
    one = keep(packed_texts(texts).dropDuplicates(["node"]), "near-texts")
    full = pairs.join(one.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(one.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            good = pa.array([similar(zlib.decompress(x).decode(), zlib.decompress(y).decode(), least) for x, y in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])

    return full.select("a", "b", "text_a", "text_b").mapInArrow(judge, "a binary, b binary")


def settled(hooks: DataFrame) -> DataFrame:
    """hooks(node, root), a forest, with every root the top of its tree; each round halves the height."""
    while True:
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("far"))
        step = keep(hooks.join(up, "root", "left").select("node", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "near-hooks")
        hooks = step.select("node", "root")
        if not step.where("moved").take(1):
            return hooks


def components(links: DataFrame) -> DataFrame:
    """node, root of every linked node that is not its component's smallest one.

    Each round hooks nodes to their smallest smaller neighbour and goes on with the links between the trees that come of it, so
    the links fall away from round to round.
    """
    edges = keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-links")
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    while edges.take(1):
        hooks = settled(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("far"))
        labels = keep(labels.join(up, "root", "left").select("node", F.coalesce("far", "root").alias("root")).unionByName(hooks), "near-labels")
        left = edges.join(hooks.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(hooks.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
        ends = left.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b")
        edges = keep(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-links")
    return labels


def near_classes(docs: DataFrame, values: int = 48, short_values: int = 24, least: float = 0.8) -> DataFrame:
    """node, root for the distinct texts that are linked to a smaller one.

    Leaders link most of a bucket; then each text meets its nearest text of another component; then all pairs of a bucket
    that are still of different components meet, so that no two similar texts that share a value stay apart.
    """
    spark = docs.sparkSession
    # batches, splits and row groups are bounded, as those of texts and of cells, not the rows, make a task's memory
    with bounded(spark), scratch(spark):
        made = keep(sketches(docs, values, short_values), "near-sketches")
        nodes = made.where(F.col("sketch").isNotNull()).dropDuplicates(["node"])
        members = bucket_members(nodes)
        seen = keep(leader_pairs(members), "near-pairs")
        with scratch(spark):
            links = keep(verified(keep(possible(seen, nodes, least), "near-pairs"), docs, least), "near-similar", result=True)
        roots = rooted(links)
        for nearest in (True, False):
            pairs = keep(open_pairs(members, nodes, roots, least, nearest).join(seen, ["a", "b"], "left_anti"), "near-pairs")
            if not pairs.take(1):
                continue
            with scratch(spark):
                found = keep(verified(pairs, docs, least), "near-similar", result=True)
            seen, links = seen.unionByName(pairs), links.unionByName(found)
            if found.take(1):
                roots = rooted(links)
        return keep(roots, "near-roots", result=True)


def rooted(links: DataFrame) -> DataFrame:
    with scratch(links.sparkSession):
        return keep(components(links), "near-roots", result=True)


def class_of(roots: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, node) as stored, and node, root of their distinct texts; null texts are a text of their own."""
    rows = keep(docs.select("doc_id", F.when(F.col("text").isNull(), F.lit(b"")).otherwise(node_of("text")).alias("node")), "near-rows")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).join(roots, "node", "left")
    return rows, nodes.withColumn("root", F.coalesce("root", "node"))


def classify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, class_size: one row per document; class_id is the smallest doc_id of its class."""
    rows, nodes = class_of(near_classes(docs, **options), docs)
    nodes = keep(nodes, "near-nodes")
    sizes = nodes.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size"))
    named = spread_join(nodes.select("node", "root"), sizes, "root", "node").drop("root")
    return spread_join(rows, named, "node", "doc_id").select("doc_id", "class_id", "class_size")


def drop_near(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, with its columns as they are: the one of the smallest doc_id."""
    _, nodes = class_of(near_classes(docs, **options), docs)
    chosen = nodes.groupBy("root").agg(F.min(F.struct("first", "node")).alias("x")).select(F.col("x.first").alias("__id"), F.col("x.node").alias("__node"))
    node = F.when(F.col("text").isNull(), F.lit(b"")).otherwise(node_of("text"))
    found = docs.join(chosen, (node == F.col("__node")) & docs["doc_id"].eqNullSafe(F.col("__id")))
    again = F.row_number().over(Window.partitionBy("__node").orderBy("__node"))  # equal rows that share a doc_id
    return found.withColumn("__again", again).where("__again = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7(docs: DataFrame) -> DataFrame:
    return classify(docs)
