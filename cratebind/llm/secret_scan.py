"""Secret scans: fixed patterns, and formats inferred from what they find.

The credentials that the patterns label train one probabilistic automaton for each kind: their prefix tree's states are
merged wherever their counts are statistically compatible. Every other token is scored by its likelihood under those formats
against one counted from all unlabelled tokens of the corpus; what a format explains far better is added as a span.

Rules for odd input: null and empty texts have no span and the digest of an empty string; repeated rows are scanned each;
equal spans of different kinds stay apart; without labelled credentials nothing is added; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, keep

# fixed values: the patterns and least lengths of the contract
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")  # as short as the shortest labelled credential
LEAST = 6

SIZES = {"d": 10, "h": 6, "l": 20, "U": 26}
CLASSES = str.maketrans({**{c: "d" for c in "0123456789"}, **{c: "h" for c in "abcdef"}, **{chr(c): "l" for c in range(ord("g"), ord("z") + 1)}, **{chr(c): "U" for c in range(ord("A"), ord("Z") + 1)}})


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, credential) of every match, by start, then kind."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
    """The tokens outside the base spans, and what the base spans leave of others."""
    found = [m.span() for m in TOKEN.finditer(text)]
    if not base:
        return found
    out = []
    for a, b in found:
        for s, _, e, _ in base:
            if e > a and s < b:
                if s - a >= LEAST:
                    out.append((a, s))
                a = max(a, e)
        if b - a >= LEAST:
            out.append((a, b))
    return out


class Automaton:
    """A probabilistic automaton over character classes, inferred from samples by state merging."""

    def __init__(self, samples: list[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends = [0]
        self.slack = math.sqrt(0.5 * math.log(2 / alpha))
        for sample in samples:
            at = 0
            for c in sample.translate(CLASSES):
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                at = self.next[at][c]
            self.ends[at] += 1
        self.merge()

    def total(self, q: int) -> int:
        return self.ends[q] + sum(self.count[q].values())

    def alike(self, p: int, q: int) -> bool:
        """Whether the states and all that follows them agree within Hoeffding's bound."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = self.total(p), self.total(q)
            if not n or not m:
                continue
            bound = self.slack * (n**-0.5 + m**-0.5)
            if abs(self.ends[p] / n - self.ends[q] / m) > bound:
                return False
            for c in {*self.count[p], *self.count[q]}:
                if abs(self.count[p].get(c, 0) / n - self.count[q].get(c, 0) / m) > bound:
                    return False
                if c in self.next[p] and c in self.next[q]:
                    todo.append((self.next[p][c], self.next[q][c]))
        return True

    def fold(self, p: int, q: int) -> None:
        """Add the tree below q to p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.ends[p] += self.ends[q]
            for c, n in self.count[q].items():
                self.count[p][c] = self.count[p].get(c, 0) + n
                if c in self.next[p]:
                    todo.append((self.next[p][c], self.next[q][c]))
                else:
                    self.next[p][c] = self.next[q][c]

    def merge(self) -> None:
        kept, seen = [0], {0}
        while edge := next(((p, c) for p in kept for c in sorted(self.next[p]) if self.next[p][c] not in seen), None):
            p, c = edge
            q = self.next[p][c]
            if (r := next((r for r in kept if self.alike(r, q)), None)) is None:
                kept.append(q)
                seen.add(q)
            else:
                self.next[p][c] = r
                self.fold(r, q)
        self.logs = {}
        for q in kept:
            n = self.total(q) + 0.5
            self.logs[q] = ({c: (math.log((m + 0.01) / n / SIZES.get(c, 1)), self.next[q][c]) for c, m in self.count[q].items()}, math.log((self.ends[q] + 0.01) / n))

    def log_likelihood(self, classes: str) -> float:
        at, total = 0, 0.0
        for c in classes:
            step = self.logs[at][0].get(c)
            if step is None:
                total -= 9.0  # unknown here: a fixed price, and the state stays
            else:
                total += step[0]
                at = step[1]
        return total + self.logs[at][1]


class Background:
    """Likelihood of ordinary tokens: each class after the three before it, from counts of every token of the corpus."""

    def __init__(self, counts: list[tuple[str, str, int]]):
        after: dict[str, dict[str, int]] = {}
        for context, c, n in counts:
            after.setdefault(context, {})[c] = n
        self.logs = {k: {c: math.log((n + 0.5) / (sum(v.values()) + 6) / SIZES.get(c, 1)) for c, n in v.items()} for k, v in after.items()}
        self.new = {k: math.log(0.5 / (sum(v.values()) + 6)) for k, v in after.items()}

    def log_likelihood(self, classes: str) -> float:
        total, context = 0.0, "^^^"
        for c in classes + "$":
            found = self.logs.get(context, {}).get(c)
            total += self.new.get(context, math.log(0.5 / 6)) - math.log(SIZES.get(c, 1)) if found is None else found
            context = context[1:] + c
        return total


def gather(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: kind and value of what the patterns find (n null), and context, class and n of all other tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps: Counter = Counter()
        for batch in batches:
            kinds, values, shapes = [], [], Counter()
            for text in batch.column(0).to_pylist():
                base = base_spans(text)
                kinds += [k for _, k, _, _ in base]
                values += [v for *_, v in base]
                shapes.update([text[a:b].translate(CLASSES) for a, b in candidates(text, base)])
            for shape, n in shapes.items():
                context = "^^^"
                for c in shape + "$":
                    steps[context, c] += n
                    context = context[1:] + c
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(values, pa.string()), pa.nulls(len(kinds), pa.string()), pa.nulls(len(kinds), pa.int64())], ["kind", "value", "next", "n"])
        keys = list(steps)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.int32()), pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(steps.values()), pa.int64())], ["kind", "value", "next", "n"])

    return documents(docs).select("text").mapInArrow(work, "kind int, value string, next string, n long")


def learn_formats(docs: DataFrame, sample: int = 400, longest: int = 200) -> dict:
    """One automaton for each kind, from at most `sample` distinct values each, of at most `longest` characters, chosen by hash:
    the documented bound of the labelled rows; and the background of all other tokens of all documents."""
    found = keep(gather(docs), "secrets-found")

    def some(kind: int) -> list[str]:
        values = found.where((F.col("kind") == kind) & (F.length("value") <= longest)).select("value").distinct()
        return sorted(r["value"] for r in values.orderBy(F.xxhash64("value"), "value").limit(sample).collect())

    labelled = [Automaton(values) for k in range(3) if (values := some(k))]
    steps = found.where("n is not null").groupBy("value", "next").agg(F.sum("n").alias("n")).collect()  # 11 ** 4 at most
    return {"formats": labelled, "rest": Background([(r["value"], r["next"], r["n"]) for r in steps])}


class Judge:
    """Whether a token is of a learned format, remembered by its classes."""

    def __init__(self, model: dict, least_gain: float, most: int = 200_000):
        self.formats, self.rest, self.least, self.most = model["formats"], model["rest"], least_gain, most
        self.known: dict[str, bool] = {}

    def __call__(self, value: str) -> bool:
        shape = value.translate(CLASSES)
        found = self.known.get(shape)
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            found = self.known[shape] = max(f.log_likelihood(shape) for f in self.formats) - self.rest.log_likelihood(shape) >= self.least
        return found

    def spans(self, text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
        return [(a, b) for a, b in candidates(text, base) if self(text[a:b])] if self.formats else []


def scan_secrets(docs: DataFrame, least_gain: float = 12.0) -> DataFrame:
    """doc_id, base, added: the pattern spans and the spans whose format likelihood is exp(least_gain) times the ordinary one."""
    key = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(learn_formats(docs))  # bounded by the samples and the classes
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value, least_gain)
        for batch in batches:
            bases, added = [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                bases.append([{"start": s, "kind": k, "end": e} for s, k, e, _ in base])
                added.append([{"start": a, "kind": 3, "end": b} for a, b in judge.spans(text, base)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, span), pa.array(added, span)], ["doc_id", "base", "added"])

    kind = "array<struct<start:int,kind:int,end:int>>"
    return documents(docs).mapInArrow(find, f"doc_id {key}, base {kind}, added {kind}")


def redact_secrets(docs: DataFrame, least_gain: float = 12.0) -> DataFrame:
    """The documents with every secret replaced in text, and n_chars, where there is such a column, of what is left."""
    shared = docs.sparkSession.sparkContext.broadcast(learn_formats(docs))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value, least_gain)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                spans = [(s, e) for s, _, e, _ in base] + (judge.spans(text, base) if text else [])
                out.append(redact(text, spans) if spans else text)
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
            if (at := batch.schema.get_field_index("n_chars")) >= 0:
                sizes = pa.array([None if t is None else len(t) for t in out], batch.schema.field(at).type)
                batch = batch.set_column(at, batch.schema.field(at), sizes)
            yield batch

    return docs.mapInArrow(clean, docs.schema)


def joined(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op6(docs: DataFrame) -> DataFrame:
    out = scan_secrets(docs)

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    n = [count(k) for k in range(3)]
    every = F.array_sort(F.concat("base", "added"))
    return out.select("doc_id", *n, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"))


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """text with every stretch of spans, joined where they overlap, replaced by the mark."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
