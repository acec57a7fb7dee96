"""Language-model scoring by online logistic context mixing over the bits of every text.

The mixing itself is in `mixer`: hashed-context bit predictors, gated weights and an adaptive map, all of which learn after
every bit of every text. The corpus gives the predictors' tables: counts of the symbols that follow each context in all training
documents, summed per task before the shuffle and by table block after it. Tables grow with the training words, up to 2^MOST_ROWS
rows for each predictor, which bounds what is broadcast. The starting weights and map are means of what training documents set
aside for it (one of 64 by hash) end with, of those that moved them, under tables that lack these documents; the tables that score hold those documents, too.
The contract's base is counted apart: word counts are shuffled by word and joined back to chunks of documents.

Rules for odd input: null and empty texts have one token, their end; a text without known words has n_known 0 or 1; when
nothing is learned, N and V are 0 and both scores are those of the base; very long texts are taken whole, in stretches of
2^17 symbols whose state starts afresh; repeated rows are scored alike and each learned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, keep, remainder, slices
from .mixer import BITS, ORDERS, Alphabet, Mixer, context_counts, plain, table_logits

END = b"\n"  # no word holds white space
CHUNK = 12_000_000
POOL = 24_000_000  #: characters of the texts that share the lanes of a mixer
MOST_ROWS = 19
BLOCK_ROWS = 12
LOTS = 64
NAMES = ["chunk", "doc_id", "digest", "ids", "words", "n", "octets"]


def digest() -> Column:
    """Of a row's key and text: rows that share it are scored alike, and no group of copies meets under one."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.col("text"))))


def count_chunks(docs: DataFrame, key: str) -> DataFrame:
    """Rows of two kinds, by chunk: a document as numbers of its chunk's distinct words; a chunk's words as hashes, with
    their counts in its training documents, and the counts of those documents' bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, learn = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, j in slices(texts, CHUNK):
                number: dict[bytes, int] = {END: 0}
                ids, octets = [], np.zeros(256, np.int64)
                for t, good in zip(texts[i:j], learn[i:j], strict=True):
                    words = t.encode().lower().split()
                    ids.append(np.array([number.setdefault(w, len(number)) for w in words] + [0], np.uint32))
                    if good:
                        octets += np.bincount(np.frombuffer(b" ".join(words) + END, np.uint8), minlength=256)
                n = np.zeros(len(number), np.int64)
                for x, good in zip(ids, learn[i:j], strict=True):
                    if good:
                        n += np.bincount(x, minlength=len(number))
                hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in number], np.uint64).astype(np.int64)
                chunk = task << 32 | serial
                serial += 1
                k = j - i
                kinds = [pa.int64(), batch.schema.field(0).type, pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
                rows = [[chunk] * k, batch.column(0).slice(i, k), batch.column(3).slice(i, k), [x.tobytes() for x in ids], [None] * k, [None] * k, [None] * k]
                told = [[chunk], [None], [None], [None], [hashes], [n.astype(np.int32)], [octets]]
                for part in (rows, told):
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(part, kinds, strict=True)], NAMES)

    rows = docs.select("doc_id", "text", "learn", digest().alias("digest"))
    return rows.mapInArrow(work, f"chunk long, doc_id {key}, digest binary, ids binary, words array<long>, n array<int>, octets array<long>")


def base_scores(chunks: DataFrame, counts: DataFrame, total: int, distinct: int, key: str) -> DataFrame:
    """doc_id, digest, n_tokens, n_known, base_score of every document."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        pos, c = (right.column(x).to_numpy() for x in ("pos", "c"))
        ids = [np.frombuffer(x, np.uint32) for x in left.column("ids").to_pylist()]
        count = np.zeros(max([int(pos.max()) + 1 if len(pos) else 0, *(int(x.max()) + 1 for x in ids)]), np.int64)
        count[pos] = c
        base = np.log10((count + 0.5) / (total + 0.5 * (distinct + 1)))
        known = count > 0
        return pa.table({
            "doc_id": left.column("doc_id"), "digest": left.column("digest"), "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
            "n_known": pa.array([int(known[x].sum()) for x in ids], pa.int64()), "base_score": pa.array([float(base[x].sum()) for x in ids], pa.float64()),
        })

    rows = chunks.where(F.col("words").isNull()).select("chunk", "doc_id", "digest", "ids")
    words = chunks.where(F.col("words").isNotNull()).select("chunk", F.posexplode("words").alias("pos", "word"))
    known = words.join(counts, "word").select(F.col("chunk").alias("of"), "pos", "c")
    return rows.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(work, f"doc_id {key}, digest binary, n_tokens long, n_known long, base_score double")


def steps(ascending: np.ndarray) -> bytes:
    """Ascending numbers as their differences, which compress better."""
    return np.diff(ascending, prepend=np.uint32(0)).astype(np.uint32).tobytes()


def tables(docs: DataFrame, alphabet: Alphabet, bits: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The predictors' tables of docs(text, tune): without the tuning documents, and of all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = TaskContext.get().partitionId() % LOTS
        for batch in batches:
            texts, tune = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in slices(texts, POOL):
                for aside in (False, True):
                    streams = [plain(t) for t, a in zip(texts[i:j], tune[i:j], strict=True) if a == aside]
                    for order, cell, n in context_counts(streams, alphabet, bits):
                        if not len(cell):
                            continue
                        of = cell >> np.uint32(BLOCK_ROWS + BITS)
                        cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                        block, parts = of[cut], list(zip(cut.tolist(), [*cut[1:].tolist(), len(cell)], strict=True))
                        yield pa.RecordBatch.from_arrays([
                            pa.array([order] * len(parts), pa.int32()), pa.array(block, pa.int32()), pa.array([lot] * len(parts), pa.int32()), pa.array([aside] * len(parts), pa.bool_()),
                            pa.array([steps(cell[a:b] & np.uint32((1 << (BLOCK_ROWS + BITS)) - 1)) for a, b in parts], pa.binary()),
                            pa.array([n[a:b].astype(np.uint32).tobytes() for a, b in parts], pa.binary()),
                        ], ["order", "block", "lot", "aside", "cells", "n"])

    def summed(table: pa.Table) -> np.ndarray:
        out = np.zeros((2, 1 << (BLOCK_ROWS + BITS)), np.int64)
        for aside, cells, n in zip(*(table.column(c).to_pylist() for c in ("aside", "cells", "n")), strict=True):
            out[int(aside), np.frombuffer(cells, np.uint32).cumsum()] += np.frombuffer(n, np.uint32)
        return out

    def lots(table: pa.Table) -> pa.Table:
        found = summed(table)
        at = [np.flatnonzero(x).astype(np.uint32) for x in found]
        one = table.slice(0, 1)
        return pa.table({
            "order": pa.concat_arrays([*one.column("order").chunks] * 2), "block": pa.concat_arrays([*one.column("block").chunks] * 2), "aside": pa.array([False, True]),
            "cells": pa.array([steps(a) for a in at], pa.binary()), "n": pa.array([np.minimum(x[a], 2**32 - 1).astype(np.uint32).tobytes() for x, a in zip(found, at, strict=True)], pa.binary()),
        })

    def finish(table: pa.Table) -> pa.Table:
        rest, tuned = summed(table)
        both = [pa.array([table_logits(x.reshape(-1, 1 << BITS)).tobytes()], pa.binary()) for x in (rest, rest + tuned)]
        return pa.table({"order": table.column("order").slice(0, 1), "block": table.column("block").slice(0, 1), "part": both[0], "whole": both[1]})

    kind = "order int, block int, aside boolean, cells binary, n binary"
    rows = docs.select("text", "tune").mapInArrow(count, "order int, block int, lot int, aside boolean, cells binary, n binary")
    made = rows.groupBy("order", "block", "lot").applyInArrow(lots, kind).groupBy("order", "block").applyInArrow(finish, "order int, block int, part binary, whole binary")
    out = [[table_logits(np.zeros((1 << b, 1 << BITS), np.int64)) for b in bits] for _ in range(2)]
    for r in made.toLocalIterator():  # bounded by MOST_ROWS
        at = r["block"] << BLOCK_ROWS
        for whole, found in zip(out, (r["part"], r["whole"]), strict=True):
            rows_of_block = np.frombuffer(found, np.int8).reshape(-1, 1 << BITS)
            size = len(whole[r["order"]])
            whole[r["order"]][at : at + (1 << BLOCK_ROWS)] = rows_of_block[: size - at]
    return out[0], out[1]


def tune(docs: DataFrame, mixer: Mixer, rounds: int = 2) -> None:
    """The mixer's starting weights and map: means of those with which the tuning documents end, where they moved."""
    spark = docs.sparkSession
    n_weights = mixer.weights.size

    def gather(shared):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start = np.concatenate([shared.value.weights.ravel(), shared.value.map])
            total, n = np.zeros(start.size), np.zeros(start.size, np.int64)
            for batch in batches:
                texts = batch.column(0).to_pylist()
                for i, j in slices(texts, POOL):
                    found: list = []
                    shared.value.bits_of([plain(t) for t in texts[i:j]], learned=found)
                    for weights, maps in found:
                        now = np.concatenate([weights.ravel(), maps])
                        moved = now != start
                        total += np.where(moved, now, 0)
                        n += moved
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(start.size), pa.int32()), pa.array(total, pa.float64()), pa.array(n, pa.int64())], ["at", "value", "n"])

        return work

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(mixer)
        rows = docs.select("text").mapInArrow(gather(shared), "at int, value double, n long")
        found = rows.groupBy("at").agg(F.sum("value").alias("value"), F.sum("n").alias("n")).where("n > 0").toPandas()  # of fixed size
        shared.destroy()
        state = np.concatenate([mixer.weights.ravel(), mixer.map])
        state[found["at"].to_numpy()] = (found["value"] / found["n"]).to_numpy()
        mixer.weights, mixer.map = state[:n_weights].reshape(mixer.weights.shape), state[n_weights:]


def mixed_bits(docs: DataFrame, mixer: Mixer) -> DataFrame:
    """digest, n_bytes, bits: the mixer's total bits of every distinct row; equal texts of a batch are mixed once."""
    shared = docs.sparkSession.sparkContext.broadcast(mixer)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in slices(texts, POOL):
                once: dict[bytes, int] = {}
                at = np.array([once.setdefault(plain(t), len(once)) for t in texts[i:j]], np.int64)
                bits = shared.value.bits_of(list(once))
                sizes = np.array([len(s) for s in once])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), pa.array(sizes[at], pa.int64()), pa.array(bits[at], pa.float64())], ["digest", "n_bytes", "bits"])

    return docs.select("text", digest().alias("digest")).mapInArrow(work, "digest binary, n_bytes long, bits double").dropDuplicates(["digest"])


def score(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every document; learns where `training` holds."""
    key = docs.schema["doc_id"].dataType.simpleString()
    crc = remainder(F.col("doc_id"), 1 << 31)
    flagged = documents(docs).select("doc_id", "text", training.alias("learn"), (training & (F.floor(crc / 5) % 64 == 0)).alias("tune"))
    chunks = keep(count_chunks(flagged, key), "lm-chunks", "zstd")
    told = chunks.where(F.col("words").isNotNull())
    words = told.select(F.explode(F.arrays_zip("words", "n")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.n").alias("n"))
    counts = keep(words.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "lm-counts")
    facts = counts.agg(F.sum("c").alias("c"), F.count("*").alias("v")).first()
    total, distinct = facts["c"] or 0, facts["v"]
    base = base_scores(chunks, counts, total, distinct, key).withColumn("train_tokens", F.lit(total).cast("long"))
    shown = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score"]
    if not total:
        return base.select(*shown, F.col("base_score").alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    octets = np.zeros(256, np.int64)
    for r in told.select(F.posexplode("octets").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():  # 256 rows
        octets[r["at"]] = r["n"]
    alphabet = Alphabet(octets)
    rows = min(MOST_ROWS, max(11, math.ceil(math.log2(total / 16 + 1))))
    part, whole = tables(flagged.where("learn"), alphabet, [11, rows, rows][:ORDERS])
    mixer = Mixer(part, alphabet)
    tune(flagged.where("tune"), mixer)
    mixer.tables = [t.reshape(-1) for t in whole]
    bits = mixed_bits(flagged, mixer)
    return base.join(bits, "digest").select(*shown, (F.col("bits") * -math.log10(2)).alias("score"), (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"))


def op2(docs: DataFrame) -> DataFrame:
    out = score(docs, remainder(F.col("doc_id"), 5) != 1)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
