"""Runs, phrases and exact copies against brute force, on odd rows and on empty tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cratebind.llm import chunk_dedup, phrases, runs
from cratebind.llm.common import shared_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, runs int, key string, rank int"


def docs_of(spark, rows):
    """rows of (doc_id, text, lang), with further columns whose names clash with results."""
    return spark.createDataFrame([(i, t, la, "s", 1, 7.0, 7, "k", 7) for i, t, la in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    vocabulary = ["ab", "Ba", "cé", "d", "e f", "g-h"]
    rows = [(1, None, "aa"), (2, "", None), (3, " \t\n", "aa"), (4, "Abc, abc. ABC", None), (4, "Abc, abc. ABC", None), (None, "abc, abc. abc", "aa"), (5, "x " * 40_000, "bb"), (6, "y" * 50_000, "bb")]
    for i in range(10, 120):
        words = [rng.choice(vocabulary) + rng.choice(["", "", ".", ","]) for _ in range(rng.randint(0, 60))]
        at, unit = rng.randint(0, len(words)), [rng.choice(vocabulary) for _ in range(rng.randint(1, 5))]
        words[at:at] = unit * rng.randint(1, 7)
        rows.append((i, rng.choice([" ", "  ", "\n", "\t"]).join(words), "aa" if i % 3 else "bb"))
    rows += [(i + 500, rows[20][1].upper(), "aa") for i in range(5)]
    return docs_of(spark, rows)


def brute_runs(word, exponent, least):
    found = {}
    for q in range(1, len(word) // exponent + 1):
        i = 0
        while i + q < len(word):
            j = i
            while j + q < len(word) and word[j] == word[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


@pytest.mark.parametrize("exponent, least", [(4, 6), (4, 4), (3, 6), (2, 6)])
def test_runs_against_brute_force(exponent, least):
    rng = random.Random(exponent * 10 + least)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 4)):
            word = [rng.choice("abcde"[: rng.choice([1, 2, 3, 5])]) for _ in range(rng.randint(0, 40))]
            for _ in range(rng.randint(0, 2)):
                unit, at = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))], rng.randint(0, len(word))
                word[at:at] = unit * rng.randint(2, 7) + unit[: rng.randint(0, len(unit))]
            texts.append(word)
        for word, (found, own) in zip(texts, runs.runs_of([" ".join(w).encode() for w in texts], exponent, least), strict=True):
            assert found == brute_runs(word, exponent, least)
            dropped = {i for s, n, q in found for i in range(s + q, s + n)}
            assert own == [w.encode() for i, w in enumerate(word) if i not in dropped]


def test_runs_of_a_very_long_text():
    word = [str(i % 700) for i in range(300_000)]
    assert next(runs.runs_of([" ".join(word).encode()], 4, 6))[0] == [(0, 300_000, 700)]


def test_op11_against_brute_force(spark, odd):
    found = runs.op11(odd).collect()
    assert len(found) == odd.count() and runs.op11(odd.limit(0)).collect() == []
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    planted = 0
    for r in found:
        word = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")
        h = zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode())
        if h % 10 == 0 and word:
            g, n = h // 10, len(word)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            word = [w if i < a else word[a + (i - a) % p] for i, w in enumerate(word)]
            planted += 1
        every = brute_runs(word, 4, 6) if len(word) < 1000 else [(0, len(word), 1)]
        assert r["n_runs"] == len(every)
        best = min(every, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (None if best[1] is None else 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in every).encode()).hexdigest()
        dropped = {i for s, n, q in every for i in range(s + q, s + n)}
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for i, w in enumerate(word) if i not in dropped).encode()).hexdigest()
    assert planted


def test_runs_refuse_what_they_could_miss(odd):
    with pytest.raises(ValueError):
        runs.collapse_runs(odd, exponent=2, least=4)


def test_perfect_hash_is_minimal_and_knows_its_keys():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 100, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64))
        look = phrases.PerfectHash(keys)
        assert sorted(look(keys).tolist()) == list(range(len(keys)))
        others = np.setdiff1d(rng.integers(0, 1 << 63, 1000, dtype=np.int64).view(np.uint64), keys)
        assert (look(others) == -1).all()


def brute_phrases(rows, longest, least, percent, k):
    f, n = {}, Counter()
    for _, text, lang in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    key = (lang or "und", tuple(words[i : i + size]))
                    f[key] = f.get(key, 0) + 1
    out = []
    every = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    for (lang, p), a in every.items():
        longer = [b for (la, q), b in every.items() if la == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= percent * a for b in longer):
            continue
        score, cut = min((1_000_000 * a * a // (f[lang, p[:c]] * f[lang, p[c:]]), c) for c in range(1, len(p)))
        out.append((lang, score, a, " ".join(p), f[lang, p[:cut]], f[lang, p[cut:]], n[lang]))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))[:k]
        ranked += [(x[0], i + 1, x[3], x[2], x[4], x[5], x[6], x[1]) for i, x in enumerate(own)]
    return sorted(ranked)


@pytest.mark.parametrize("longest, least, percent, k, block", [(3, 10, 50, 2000, 1 << 21), (4, 3, 90, 7, 5), (2, 2, 50, 2000, 40)])
def test_phrases_against_brute_force(odd, monkeypatch, longest, least, percent, k, block):
    monkeypatch.setattr(phrases, "BLOCK", block)  # small blocks: several passes
    monkeypatch.setattr(phrases, "CHUNK", 8)
    monkeypatch.setattr(phrases, "KEYS_A_RANGE", 1000)
    monkeypatch.setattr(phrases, "WORDS_A_SLICE", 900)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    found = phrases.collocations(odd, longest, least, percent, k).collect()
    assert sorted(map(tuple, found)) == brute_phrases(rows, longest, least, percent, k)
    assert found


def test_phrases_delete_what_passes_leave(spark, odd, monkeypatch):
    """However many passes a level takes, its places are on disk twice at most; in the end phrases alone are there."""
    held, keep = [], phrases.keep

    def there():
        return [x.rsplit("-", 1)[0] for x in os.listdir(shared_folder(spark).removeprefix("file://"))]

    def watched(*args, **more):
        out = keep(*args, **more)
        held.append(sum(x.startswith("phrase-s") for x in there()) - before)
        return out

    before = sum(x.startswith("phrase-s") for x in there())
    monkeypatch.setattr(phrases, "keep", watched)
    monkeypatch.setattr(phrases, "BLOCK", 5)
    all_before = Counter(there())
    assert phrases.collocations(odd, 3, 3, 90, 7).collect()
    assert len(held) > 12 and max(held) <= 3
    assert set(Counter(there()) - all_before) == {"phrases-2", "phrases-3", "languages"}


def test_phrases_of_nothing(spark, odd):
    assert phrases.op12(odd.limit(0)).collect() == []
    assert phrases.op12(docs_of(spark, [(1, None, None), (2, "one two", "aa")])).collect() == []


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_duplicates(spark, odd, bits):
    """3 bits of hash: nearly all chunks clash, and identifiers are told apart by their texts."""
    long = " ".join(random.Random(1).choice(["alpha", "goal", "dry", "lost", "sad"]) for _ in range(30_000))
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    rows += [(900, long, "aa"), (901, long.upper(), "aa"), (902, long + ".", "aa"), (903, "." + long, "aa"), (904, long[:100_000] + "É" + long[100_000:], "aa"), (905, long[:100_000] + "é" + long[100_000:], "aa")]
    found = chunk_dedup.exact_duplicates(docs_of(spark, rows), bits).collect()
    assert len(found) == len(rows)
    plain = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(hashlib.sha256(plain(t).encode()).hexdigest(), []).append(i)
    assert sum(r["kept"] for r in found) == len(groups)
    for r in found:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["doc_id"] in ids
        assert r["keep_id"] == max(ids, key=lambda x: -1 if x is None else x)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]


def test_exact_duplicates_of_nothing(odd):
    assert chunk_dedup.op13(odd.limit(0)).collect() == []


def test_chunks_are_whole_and_find_their_place_again(spark):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("adglorsy") for _ in range(rng.randint(2, 8))) for _ in range(20_000))
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, text), (2, "something else, " * 3 + text), (3, "z" * 20_000)], "i int, t string")
    cut = {r["i"]: r["c"] for r in df.select("i", F.regexp_extract_all("t", F.lit(chunk_dedup.CUT), F.lit(0)).alias("c")).collect()}
    assert "".join(cut[1]) == text and "".join(cut[3]) == "z" * 20_000
    assert len(set(cut[1]) & set(cut[2])) > 0.8 * len(cut[1])
    assert max(map(len, cut[1] + cut[3])) <= chunk_dedup.LONGEST + 3


def test_large_rows_are_kept_and_passed_in_bounded_pieces(spark):
    import pyarrow.parquet as pq

    from cratebind.llm.common import BATCH, ROW_GROUP, bounded, keep

    rows = spark.range(0, 60, 1, 1).select(F.expr("array_join(transform(sequence(1, 16000), x -> sha2(concat(id, '-', x), 256)), '')").cast("binary").alias("data"))
    with bounded(spark):
        kept = keep(rows, "large", large=True)
        sizes = keep(kept.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long"), "sizes")
    assert max(r["n"] for r in sizes.collect()) < BATCH + (3 << 20)
    for name in kept.inputFiles():
        found = pq.ParquetFile(name.removeprefix("file://")).metadata
        assert all(found.row_group(i).total_byte_size < ROW_GROUP + (3 << 20) for i in range(found.num_row_groups))
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") not in (str(BATCH), "33554432")


def test_near_classes_move_in_bounded_batches(spark, monkeypatch):
    from cratebind.llm import common, near_dedup

    seen, whole, conf = [], near_dedup.keep, "spark.sql.execution.arrow.maxBytesPerBatch"
    monkeypatch.setattr(near_dedup, "keep", lambda df, *a, **o: seen.append(spark.conf.get(conf, None)) or whole(df, *a, **o))
    before = spark.conf.get(conf, None)
    near_dedup.near_classes(spark.createDataFrame([(1, "a b c d e"), (2, "x y z")], "doc_id long, text string"))
    assert seen and set(seen) == {str(common.BATCH)}
    assert spark.conf.get(conf, None) == before
