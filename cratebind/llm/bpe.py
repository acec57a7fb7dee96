"""Token counts by byte-pair merging with a heap and a linked list; no token identifiers are made.

A piece's count is its bytes minus its merges. Texts are cut into pieces as the vocabulary file's byte-level pre-tokenizer
cuts them, after its special strings, which count as one token each, as the file's own library does by default.

Rules for odd input: null and empty texts have no bytes and no tokens; very long pieces take O(n log n); repeated rows are
counted each; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

from .common import documents

# fixed value: how the byte-level vocabularies cut a text into pieces
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
REMEMBERED = 400_000


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_merges(path: str) -> dict:
    """Merge ranks of a tokenizer file, over small numbers: {(left, right): (rank, merged)} packed in integers."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    names = byte_names()
    number: dict[str, int] = dict(names)
    merges = {}
    for rank, pair in enumerate(found["model"]["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        new = number.setdefault(left + right, len(number))
        merges.setdefault(number[left] << 32 | number[right], (rank, new))
    return {"merges": merges, "special": sorted((t["content"] for t in found["added_tokens"] if t["special"]), key=len, reverse=True)}


def count_piece(data: bytes, merges: dict[int, tuple[int, int]]) -> int:
    """Tokens of one piece: repeatedly merge the leftmost adjacent pair of lowest rank."""
    n = len(data)
    if n < 2:
        return n
    symbol, after, before = list(data), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(m[0], i, m[1], key) for i in range(n - 1) if (m := merges.get(key := data[i] << 32 | data[i + 1]))]
    heapify(heap)
    left = n
    while heap:
        _, i, new, key = heappop(heap)
        j = after[i]
        if symbol[i] < 0 or j >= n or symbol[i] << 32 | symbol[j] != key:
            continue  # one side was merged meanwhile
        symbol[i], symbol[j] = new, -1
        k = after[i] = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if m := merges.get(key := new << 32 | symbol[k]):
                heappush(heap, (m[0], i, m[1], key))
        if (h := before[i]) >= 0 and (m := merges.get(key := symbol[h] << 32 | new)):
            heappush(heap, (m[0], h, m[1], key))
    return left


class Counts(dict):
    """Counts of pieces, worked out when first asked for."""

    def __init__(self, merges: dict):
        self.merges = merges

    def __missing__(self, piece: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        found = count_piece(piece.encode(), self.merges)
        if len(piece) < 64:
            self[piece] = found
        return found


class Counter:
    def __init__(self, model: dict):
        self.counts = Counts(model["merges"])
        self.pieces = regex.compile(PIECES).findall
        self.special = regex.compile("|".join(map(regex.escape, model["special"]))) if model["special"] else None

    def __call__(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(map(self.counts.__getitem__, self.pieces(p))) for p in parts if p)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document, by the tokenizer file at `path` (read once, on the driver)."""
    shared = docs.sparkSession.sparkContext.broadcast(load_merges(path))  # bounded by the vocabulary file

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = [counter(t) for t in texts]
            sizes = pa.compute.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return documents(docs).mapInArrow(count, f"doc_id {key}, n_bytes long, n_tokens long, over_limit boolean")


def op4(docs: DataFrame, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return count_tokens(docs, path)
