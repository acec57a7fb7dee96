"""Durable state under conflicts and crashes, decisions by hand, the ordered log."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from cratebind.operators import caches
from cratebind.plans.decide import decide
from cratebind.sources import playlists, store
from cratebind.streaming.ordered import in_sequence

from .test_engine import TRACK, TRACKS

ROWS = "key string, path string, bitrate int, pos int"


def rows(spark, *some):
    return spark.createDataFrame([(k, p, 1, i) for i, (k, p) in enumerate(some)], ROWS)


def table(t):
    return {r["key"]: r["path"] for r in t.read().collect()}


def test_versions_follow_each_other(spark, tmp_path):
    memory = store.Memory(spark, str(tmp_path))
    assert memory.learned.read().collect() == []
    first = memory.remember(rows(spark, ("a", "1"), ("b", "1"), ("a", "2")), ["pos"])
    memory.remember(rows(spark, ("b", "3")), ["pos"])
    assert table(memory.learned) == {"a": "2", "b": "3"} and {r["key"]: r["path"] for r in memory.learned.read(first).collect()} == {"a": "2", "b": "1"}
    memory.learned.restore(first)
    assert table(memory.learned) == {"a": "2", "b": "1"}
    for i in range(4):
        memory.learned.update(lambda old: old, backups=2)
    assert len(memory.learned.commits()) == 3 and len(list((tmp_path / "learned" / "versions").iterdir())) == 3
    assert table(memory.learned) == {"a": "2", "b": "1"}


def test_two_writers_lose_no_key(spark, tmp_path):
    memory = store.Memory(spark, str(tmp_path))
    meet = threading.Barrier(2, timeout=60)
    failed = []

    def write(name):
        met = []

        def change(old):
            if not met:
                met.append(1)
                meet.wait()  # both have read the same state
            return caches.upsert(old, rows(spark, (name, name)), ["pos"])

        try:
            memory.learned.update(change)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    both = [threading.Thread(target=write, args=(n,)) for n in ("a", "b")]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert not failed and table(memory.learned) == {"a": "a", "b": "b"}


def test_a_crash_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    memory = store.Memory(spark, str(tmp_path))
    memory.remember(rows(spark, ("a", "1")), ["pos"])

    def crash(*_):
        raise RuntimeError("power cut")

    monkeypatch.setattr(store.Table, "_commit", crash)
    with pytest.raises(RuntimeError):
        memory.remember(rows(spark, ("a", "2")), ["pos"])
    monkeypatch.undo()
    assert table(memory.learned) == {"a": "1"}
    memory.remember(rows(spark, ("b", "3")), ["pos"])
    assert table(memory.learned) == {"a": "1", "b": "3"}
    monkeypatch.setattr(store.Table, "_commit", lambda *_: False)
    with pytest.raises(store.Conflict):
        memory.learned.update(lambda old: old, retries=2)


def test_aliases_take_in_what_is_new(spark, tmp_path):
    memory = store.Memory(spark, str(tmp_path))
    memory.accept(spark.createDataFrame([("Ana R.", "Ana Ruiz"), ("ANA RUIZ", "ana ruiz"), (" ", "x"), (None, "x")], store.ALIASES))
    memory.accept(spark.createDataFrame([("ana r", "ANA RUIZ"), ("Luis", "Luis Mar"), ("Ana R.", "Ana Rosa")], store.ALIASES))
    assert {tuple(r) for r in memory.aliases.read().collect()} == {("Ana R.", "Ana Rosa"), ("Luis", "Luis Mar")}


def test_decisions_rewrite_their_playlists_alone(spark, tmp_path):
    for name, text in {"a.m3u": "D:/x.mp3\nD:/y.mp3\n", "b.m3u": "D:/z.mp3\n", "c.m3u": "D:/w.mp3\n"}.items():
        (tmp_path / name).write_text(text)
    entries = playlists.read_playlists(spark, str(tmp_path)).cache()
    path = F.when(F.col("raw_path") == "D:/w.mp3", TRACKS[0][1])
    results = entries.select("playlist", "pos", "raw_path", F.lit("unmatched").alias("phase"), path.isNotNull().alias("found"), path.alias("path"))
    tracks = spark.createDataFrame(TRACKS, TRACK)
    memory = store.Memory(spark, str(tmp_path / "memory"))
    names = {r["raw_path"]: (r["playlist"], r["pos"]) for r in entries.collect()}
    said = [(*names["D:/x.mp3"], "choose", TRACKS[4][1]), (*names["D:/y.mp3"], "valid", None), (*names["D:/w.mp3"], "skip", None)]
    after = decide(entries, results, spark.createDataFrame(said, "playlist string, pos int, action string, path string"), tracks, memory, str(tmp_path / "out"))
    made = {p.name: p.read_text() for p in (tmp_path / "out").iterdir()}
    assert set(made) == {"a_actualizada.m3u", "c_actualizada.m3u"} and made["c_actualizada.m3u"] == "#EXTM3U\n"
    assert [x for x in made["a_actualizada.m3u"].split("\n") if x and x[0] != "#"] == [TRACKS[4][1], "D:/y.mp3"]
    assert table(memory.manual) == {"exact|D:/x.mp3": TRACKS[4][1], "base|x.mp3": TRACKS[4][1], "norm|x.mp3": TRACKS[4][1]}
    assert {r["phase"] for r in after.collect()} == {"manual", "valid_path", "skipped", "unmatched"}


def test_log_goes_out_in_order_once(spark, tmp_path):
    rng = random.Random(5)
    said = [("r", i, f"line {i}") for i in range(1, 41)] + [("s", i, f"other {i}") for i in range(1, 6)]
    said += rng.sample(said, 10)  # some arrive again
    rng.shuffle(said)
    (tmp_path / "in").mkdir()
    shown = {"r": [], "s": []}

    def work(batch, _):
        for r in batch.orderBy("run", "seq").collect():
            shown[r["run"]].append((r["seq"], r["text"], r["percent"]))

    for part in range(3):  # each part is a run of the stream of its own, from the checkpoint of the one before
        lines = said[part * 19 : (part + 1) * 19]
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(json.dumps({"run": a, "seq": b, "text": c}) for a, b, c in lines))
        stream = spark.readStream.schema("run string, seq long, text string").json(str(tmp_path / "in"))
        in_sequence(stream, 40).writeStream.foreachBatch(work).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    assert [s[:2] for s in shown["r"]] == [(i, f"line {i}") for i in range(1, 41)] and [s[:2] for s in shown["s"]] == [(i, f"other {i}") for i in range(1, 6)]
    assert shown["r"][-1][2] == 100 and shown["r"][9][2] == 25


def test_repairs_remember(spark, tmp_path):
    from cratebind.plans.repair import repair
    from cratebind.sources import library

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.m3u").write_text("#EXTVDJ:<title>Noche Azul</title><artist>Ana Ruiz</artist><songlength>200</songlength>\nD:/x.mp3\n")
    version = library.write_snapshot(spark.createDataFrame(TRACKS, TRACK), str(tmp_path / "lib"))
    memory = store.Memory(spark, str(tmp_path / "memory"))
    first, _ = repair(spark, str(tmp_path / "in"), version, str(tmp_path / "out"), memory=memory)
    again, _ = repair(spark, str(tmp_path / "in"), version, str(tmp_path / "out"), memory=memory)
    assert [r["phase"] for r in first.collect()] == ["identity"] and [r["phase"] for r in again.collect()] == ["memory_learned"]


def test_heavy_tokens_are_dealt_out(spark):
    from cratebind.operators import blocking

    postings = spark.range(20_000).select(F.lit("title").alias("token_type"), F.lit("remix").alias("token"), F.col("id").alias("track_id"))
    rare = spark.range(20_000).select(F.lit("title").alias("token_type"), F.concat(F.lit("w"), F.col("id") % 5000).alias("token"), F.col("id").alias("track_id"))
    every = postings.unionByName(rare).cache()
    wanted = spark.createDataFrame([("s1", "title", "remix"), ("s2", "title", "w7"), ("s2", "title", "remix"), ("s3", "title", "nothing")], "sid string, token_type string, token string")
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = blocking.token_join(wanted, every, ["token_type", "token"])
        tasks = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert sum(tasks) == 40_004 and max(tasks) <= 2 * sorted(tasks)[len(tasks) // 2]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    plain = wanted.join(every, ["token_type", "token"])
    assert sorted(found.select("sid", "track_id").collect()) == sorted(plain.select("sid", "track_id").collect())
