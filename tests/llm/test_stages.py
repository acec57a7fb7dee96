"""Pipeline stages on empty tables and many languages, near-duplicates against all pairs, kept tables that go."""

import os
import random
import re
import zlib
from collections import Counter

import pytest

from cratebind.llm import chat, common, langid, mixing, near_dedup, secret_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, la, s, 0) for i, t, la, s in rows], DOCS)


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def classes(rows, least=0.8):
    """class by all pairs of texts."""
    words = [(t or "").split() for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = words[i], words[j]
            longer = max(len(a), len(b))
            if rows[i][1] == rows[j][1] or (longer and abs(len(a) - len(b)) <= 0.2 * longer and 1 - distance(a, b) / longer >= least - 1e-9):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(rows[i][0])
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("block", [1024, 7])
def test_near_classes_equal_all_pairs(spark, monkeypatch, block):
    """Words replaced, put in and left out, in texts of 8 to 120 words; groups around a hub, and a passage that many texts share."""
    real = near_dedup.open_pairs
    monkeypatch.setattr(near_dedup, "open_pairs", lambda *a, **k: real(*a, block=block))
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]

    def edited(words, share):
        out = list(words)
        for _ in range(max(1, int(share * len(words)))):
            at, kind = rng.randrange(len(out)), rng.choice("rid")
            out[at : at + (kind != "i")] = [] if kind == "d" else [rng.choice(vocabulary)]
        return out

    rows, passage = [], make(25)
    for n in (8, 12, 20, 40, 60, 90, 120):
        for _ in range(3):
            hub = make(n)
            rows.append(hub)
            rows += [edited(hub, share) for share in (0.05, 0.1, 0.13, 0.3)]
    hub = make(80)
    rows += [edited(hub, 0.1) for _ in range(25)]
    rows += [make(40) + passage + make(40) for _ in range(25)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    rows += [(1000 + i, rows[i][1]) for i in range(0, 40, 7)]
    found = {}
    for r in near_dedup.op7(docs_of(spark, [(i, t, None, None) for i, t in rows])).collect():
        found.setdefault(r["class_id"], set()).add(r["doc_id"])
    assert {frozenset(g) for g in found.values()} == classes(rows)


def test_what_is_kept_goes_with_its_scratch(spark):
    folder = common.shared_folder(spark).removeprefix("file:").replace("//", "/")
    there = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = there()
    with common.scratch(spark):
        common.keep(spark.range(3), "gone")
        with common.scratch(spark):
            inner = common.keep(spark.range(4), "inner", result=True)
        assert inner.count() == 4
        out = common.keep(spark.range(5), "stays", result=True)
    assert out.count() == 5 and [n.split("-")[0] for n in there() - before] == ["stays"]
    before = there()
    near_dedup.near_classes(docs_of(spark, [(i, "one two three four five six", None, None) for i in range(3)])).collect()
    assert [n.rsplit("-", 1)[0] for n in there() - before] == ["near-roots"]


def test_known_languages_do_not_hang_on_their_number(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(12):  # twelve languages that share half of their words
        own = ["".join(rng.choice(letters) for _ in range(6)) for _ in range(60)]
        if k == 0:
            shared = own
        for i in range(20):
            rows.append((len(rows), " ".join(rng.choice(own if rng.random() < 0.5 else shared) for _ in range(80)), f"l{k:02}", "s"))
    clean = {i for i, *_ in rows}
    rows += [(1000, "12 345 !!", "l00", "s"), (1001, None, "l00", "s"), (1002, "", None, "s"), (1003, shared[0], None, "s"), (1004, "ξψω ξξψ ωωξ ψψω", None, "s")]
    for few in (2, 12):
        kept = {r["doc_id"] for r in langid.keep_known(docs_of(spark, [r if r[2] is None or r[2] < f"l{few:02}" else (*r[:2], None, r[3]) for r in rows])).collect()}
        assert {i for i in clean if rows[i][2] < f"l{few:02}"} <= kept
        assert kept.isdisjoint({1000, 1001, 1002, 1004}) and 1003 in kept


def test_copies_are_what_the_mix_takes(spark):
    rows = [(i, "  w" + str(i) + " " + " ".join(f"a{j}\n" for j in range(i % 9)), None, f"s{i % 3}") for i in range(90)] + [(100, None, None, "s0"), (101, " \t", None, None)]
    mixed = mixing.mix_sources(docs_of(spark, rows))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    found = mixing.with_copies(mixed).collect()
    assert len(found) == len(rows)
    for r in found:
        assert sum(size(c) for c in r["copies"]) == r["taken"]
        assert all(c == r["text"] for c in r["copies"][:-1]) and (not r["copies"] or r["text"].startswith(r["copies"][-1]))
    spread = mixing.repetitions(mixed).collect()
    assert len(spread) == sum(len(r["copies"]) for r in found) and {r["copy"] for r in spread} <= {0, 1}


def test_stages_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs_of(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.collect() == [] and (name == "mix" or out.columns == docs.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_with_python_send_whole_texts_in_bounded_batches(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    docs = docs_of(spark, [(i, f"the quick brown fox number {i} jumps over dogs", "en", "a") for i in range(40)])
    spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {}

    def kept(df, name, **options):
        seen[name] = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"), options
        return df

    monkeypatch.setattr(corpus_pipeline, "keep", kept)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert seen[f"pipeline-{name}"] == (str(common.BATCH), {"large": True})
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_a_kind_of_few_labelled_secrets_is_learned(spark):
    rows = [(i, f"see AKIA{'QWERTYUIOPASDFGH'[:16]}{i} there", None, None) for i in range(2)] + [(9, "plain words only here", None, None)]
    model = secret_scan.learn_formats(docs_of(spark, rows))
    assert len(model["formats"]) == 1


def test_language_votes_against_exact_sets(spark):
    """The predictions are those that exact sets of trigrams give, wherever these are not close to a tie."""
    rng = random.Random(12)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "klmnoabc"}
    rows = [(i, " ".join("".join(rng.choice(letters[la]) for _ in range(rng.randint(2, 7))) for _ in range(30)), la, "s") for i in range(240) for la in [("aa", "bb", "cc")[i % 3]]]
    docs = docs_of(spark, rows)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.op9(docs).collect()}
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    grams = lambda t: langid.grams([t])[0].tolist()
    counts = {la: Counter(g for r in train if r[2] == la for g in grams(r[1])) for la in letters}
    rates = {la: {g: n / sum(c.values()) for g, n in c.items()} for la, c in counts.items()}
    top = {g: max(r.get(g, 0) for r in rates.values()) for r in rates.values() for g in r}
    sets = {la: {g: x for g, x in r.items() if x >= 2e-5 and x >= 0.3 * top[g]} for la, r in rates.items()}
    near = 0
    for i, text, _, _ in rows:
        own = grams(text)
        votes = {la: sum(g in s for g in own) / sum(s.values()) for la, s in sets.items()}
        best = sorted(votes.values(), reverse=True)
        if best[0] - best[1] < 0.02 * len(own):
            near += 1
            continue
        assert found[i][0] == max(votes, key=votes.get)
        assert abs(found[i][1] - best[0] / sum(best)) < 0.02
    assert near < 12


def test_chats_without_a_conversation_and_with_long_texts(spark):
    call = '{"content":"hi","tool_calls":[{"id":"a","name":"add","arguments":{"x":1},"after":["b"]},{"id":"b","name":"add","arguments":{"x":2}}]}'
    rows = [(None, 0, "assistant", call), (None, 1, "tool", '{"tool_call_id":"a","content":"3"}'), (1, 0, "user", "x" * 600_000), (1, 1, "assistant", '{"content":"' + "y" * 600_000 + '"}'), (1, None, None, None)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"add": {"x": "integer"}}).collect()
    assert sorted((r["kind"], r["call_id"]) for r in out if r["kind"] != "message") == [("call", "a"), ("call", "b"), ("result", "a")]
    assert not any(r["linked"] for r in out if r["kind"] != "message")  # no conversation: nothing to link by
    assert sorted(len(r["json"]) > 600_000 for r in out if r["kind"] == "message") == [False, False, True, True]


def test_near_duplicates_of_very_long_texts(spark):
    rng = random.Random(4)
    long = [f"w{rng.randrange(5000)}" for _ in range(30_000)]
    near = list(long)
    for i in rng.sample(range(30_000), 1500):
        near[i] = "other"
    far = [f"v{rng.randrange(5000)}" for _ in range(30_000)]
    rows = [(1, " ".join(long), None, None), (2, " ".join(near), None, None), (3, " ".join(far), None, None), (4, "z" * 400_000, None, None), (5, "z" * 400_000, None, None)]
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.op7(docs_of(spark, rows)).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_runs_are_labelled_alike_with_and_without_repeats():
    import numpy as np

    plain = np.arange(100, 200, dtype=np.uint64)
    repeated = np.concatenate([plain, plain[:3]])
    a, b = (near_dedup.labelled_runs(x) for x in (plain, repeated))
    assert len(set(b.tolist())) == len(b) and set(a.tolist()) <= set(b.tolist())
