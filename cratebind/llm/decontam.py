"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of k is cut into k + 1 pieces, so a passage within the budget holds one of them exactly. Piece
hits come from one multi-pattern scan of a document; each is verified upwards through ever larger parts of the item, each
with its own share of the budget, by Myers' bit-parallel distance, up to the whole item.

Texts are compared in lower case with white space runs as one blank. Rules for odd input: null and blank texts and items
match nothing; items of equal text match each; a repeated document row gives its rows again; an empty table on either side
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import documents

BLOCK_CHARS = 1_000_000


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def distance_within(peq: dict[str, int], m: int, text: str) -> int:
    """Least edit distance between the pattern of length m and any part of text."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
    return best


def piece_tree(item: str, k: int) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """For each of the k + 1 pieces: start, end and the parts (start, end, budget) above it, smallest first.

    A part of p pieces has a budget of p - 1: if a whole keeps to its budget, so does one of its two halves.
    """
    cuts = [round(i * len(item) / (k + 1)) for i in range(k + 2)]
    above: list[list[tuple[int, int, int]]] = [[] for _ in range(k + 1)]
    level = [(0, k + 1)]
    while level:
        lower = []
        for a, b in level:
            if b - a > 1:
                for j in range(a, b):
                    above[j].insert(0, (cuts[a], cuts[b], b - a - 1))
                lower += [(a, (a + b) // 2), ((a + b) // 2, b)]
        level = lower
    return [(cuts[j], cuts[j + 1], above[j]) for j in range(k + 1)]


class Matcher:
    def __init__(self, items: list[tuple[object, str]], max_error: float):
        self.items, self.peq = items, {}
        pieces: dict[str, list] = {}
        for i, (_, text) in enumerate(items):
            for start, end, above in piece_tree(text, int(max_error * len(text))):
                pieces.setdefault(text[start:end], []).append((i, start, above))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if pieces:
            self.automaton.make_automaton()

    def masks(self, i: int, a: int, b: int) -> dict[str, int]:
        if (i, a, b) not in self.peq:
            self.peq[i, a, b] = masks(self.items[i][1][a:b])
        return self.peq[i, a, b]

    def __call__(self, text: str) -> dict[int, int]:
        """The least distance of every item that text holds within its budget."""
        found: dict[int, int] = {}
        if not len(self.automaton):
            return found
        done, failed = set(), set()
        for last, (size, uses) in self.automaton.iter(text):
            for i, start, above in uses:
                at = last + 1 - size - start  # where the item would begin
                if found.get(i) == 0 or (i, at) in done:
                    continue
                best = 0
                for a, b, budget in above:
                    if (i, a, b, at) in failed:
                        break
                    best = distance_within(self.masks(i, a, b), b - a, text[max(0, at + a - budget) : at + b + budget])
                    if best > budget:
                        failed.add((i, a, b, at))
                        break
                else:
                    done.add((i, at))
                    found[i] = min(best, found.get(i, best))
        return found


def blocks(items: DataFrame, limit: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    """The items, in plain text, in lists of bounded length."""
    block, size = [], 0
    for row in items.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        text = plain(row["text"])
        if text:
            if block and size + len(text) > limit:
                yield block
                block, size = [], 0
            block.append((row["item_id"], text))
            size += len(text)
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, max_error: float = 0.1) -> DataFrame:
    """doc_id, item_id, distance: every benchmark item found in a document with at most max_error edits a character.

    The benchmark is the stated query set: it is taken in blocks of at most BLOCK_CHARS characters, each broadcast and
    matched against every document.
    """
    spark = docs.sparkSession
    key, item = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType
    kind = to_arrow_type(item)
    out = None
    for block in blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, max_error)
            for batch in batches:
                at, ids, distances = [], [], []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    for i, d in matcher(plain(text)).items():
                        at.append(row)
                        ids.append(matcher.items[i][0])
                        distances.append(d)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, kind), pa.array(distances, pa.int32())], ["doc_id", "item_id", "distance"])

        found = documents(docs).mapInArrow(match, f"doc_id {key}, item_id {item.simpleString()}, distance int")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.select("doc_id").where(F.lit(False)).withColumns({"item_id": F.lit(None).cast(item), "distance": F.lit(None).cast("int")})
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, max_error: float = 0.1) -> DataFrame:
    """The documents, with their columns as they are, that hold no benchmark item."""
    for block in blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, max_error)
            for batch in batches:
                yield batch.filter(pa.array([not matcher(plain(t or "")) for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op3(docs: DataFrame, items: DataFrame) -> DataFrame:
    return find_leaks(docs, items)
