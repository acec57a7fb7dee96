"""Operators and whole plans on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from cratebind.operators import alias, blocking, caches, identity, metrics, normalise, ranking, scoring, snapshot
from cratebind.plans import queries
from cratebind.plans.cascade import match
from cratebind.plans.repair import repair
from cratebind.sources import library, playlists, state

TRACK = "track_id long, path string, title string, artist string, duration double, bitrate int, auto_tags boolean"
ENTRY = "playlist string, pos int, raw_path string, title string, artist string, duration double"
TRACKS = [
    (1, "C:/m/Ana Ruiz - Noche Azul.mp3", "Noche Azul", "Ana Ruiz", 200.0, 128, False),
    (2, "C:/m/hi/Ana Ruiz - Noche Azul.flac", "Noche Azul", "Ana Ruiz", 201.0, 320, False),
    (3, "C:/m/Ana Ruiz - Noche Azul Remix.mp3", "Noche Azul Remix", "Ana Ruiz", 240.0, 320, False),
    (4, "C:/m/Luis Mar - Viento Norte.mp3", "Viento Norte", "Luis Mar", None, None, True),
    (5, "C:/m/Pepe - Camino Largo.mp3", None, None, 100.0, 192, False),
]


def run(spark, entries, **options):
    tracks = spark.createDataFrame(TRACKS, TRACK)
    rows = match(spark.createDataFrame(entries, ENTRY), tracks, normalise.token_postings(tracks), **options).collect()
    return {r["pos"]: r for r in rows}


def test_cascade(spark):
    entries = [
        ("p", 0, "C:/m/Ana Ruiz - Noche Azul.mp3", "Noche Azul", "Ana Ruiz", 200.0),  # stands
        ("p", 1, "D:/x.mp3", "Noche Azul (Official Video)", "Ana Ruiz", 200.0),  # identity, best bitrate
        ("p", 2, "D:/y.mp3", "Viento del Norte", "Luis Mar", None),  # tags
        ("p", 3, "D:/Pepe - Camino Largo.mp3", None, None, None),  # name
        ("p", 4, "netsearch://td123456", "Zzz Qqq", "Nobody", None),  # a service id is not searched by name
        ("p", 5, "D:/unknown thing.mp3", None, None, None),
        ("p", 6, "D:/x.mp3", "Noche Azul (Official Video)", "Ana Ruiz", 200.0),  # repeated
    ]
    got = run(spark, entries)
    assert {i: r["phase"] for i, r in got.items()} == {0: "valid_path", 1: "identity", 2: "tags", 3: "name", 4: "service_unmatched", 5: "unmatched", 6: "identity"}
    assert got[1]["path"] == TRACKS[1][1] and got[2]["path"] == TRACKS[3][1] and got[3]["path"] == TRACKS[4][1] and got[5]["path"] is None
    low = run(spark, entries, only_low_bitrate=True)
    assert low[0]["phase"] == "identity" and low[0]["path"] == TRACKS[1][1]
    same = spark.createDataFrame([("p", TRACKS[0][1], 320)], "playlist string, path string, bitrate int")
    assert run(spark, entries, only_low_bitrate=True, overrides=same)[0]["phase"] == "valid_path"


def test_manual_comes_before_later_phases(spark):
    entries = [("p", 2, "D:/y.mp3", "Viento del Norte", "Luis Mar", None)]
    chosen = caches.manual_rows(spark.createDataFrame([("D:/y.mp3", TRACKS[3][1])], "label string, path string"))
    got = run(spark, entries, manual=chosen)[2]
    assert got["phase"] == "memory_manual" and got["path"] == TRACKS[3][1]
    wrong = caches.manual_rows(spark.createDataFrame([("D:/y.mp3", TRACKS[4][1])], "label string, path string"))
    assert run(spark, entries, manual=wrong)[2]["phase"] in ("memory_manual", "tags")


def test_aliases_join_artists(spark):
    entries = [("p", 0, "D:/q.mp3", "Noche Azul", "La Ruiz", 200.0)]
    plain = run(spark, entries)[0]
    assert plain["phase"] == "tags" and plain["path"] == TRACKS[0][1]  # another artist, but one of its words is in the file name
    known = spark.createDataFrame([("La Ruiz", "ana ruiz")], "variant string, canonical string")
    better = run(spark, entries, aliases=known)[0]
    assert better["phase"] == "identity" and better["path"] == TRACKS[1][1]


def test_blocking_is_within_a_full_scan(spark):
    tracks = spark.createDataFrame(TRACKS, TRACK)
    entries = normalise.normalise_entries(spark.createDataFrame([("p", 0, "a.mp3", "Noche", "Luis", 1.0), ("p", 1, "b.mp3", "Noche", "Ruiz", 1.0), ("p", 2, "c.mp3", "Camino", None, None)], ENTRY))
    pairs = blocking.tag_candidates(entries, normalise.normalise_tracks(tracks), normalise.token_postings(tracks))
    got = {(r["raw_path"], r["track_id"]) for r in pairs.collect()}
    # no track has both Noche and Luis, so either counts; Noche and Ruiz meet; Camino has no tagged track
    assert got == {("a.mp3", i) for i in (1, 2, 3, 4)} | {("b.mp3", i) for i in (1, 2, 3)}


def test_similar_join_equals_the_plain_condition(spark):
    lib = normalise.normalise_tracks(spark.createDataFrame(TRACKS, TRACK))
    asked = normalise.normalise_entries(spark.createDataFrame([("p", i, f"{d}.mp3", "Noche Azul", None, d) for i, d in enumerate([196.5, 197.0, 198.0, 200.5, 203.9, 204.1])], ENTRY))
    got = sorted((r["duration"], r["track_id"]) for r in identity.similar_join(asked, lib).collect())
    assert got == sorted((d, i) for d in [196.5, 197.0, 198.0, 200.5, 203.9, 204.1] for i, t in ((1, 200.0), (2, 201.0)) if abs(d - t) <= 3)


def test_top_candidates(spark):
    tracks = spark.createDataFrame(TRACKS, TRACK)
    e = normalise.normalise_entries(spark.createDataFrame([("p", 0, "a.mp3", "Noche Azul", "Ana Ruiz", 200.0)], ENTRY))
    got = ranking.top_candidates(e, normalise.normalise_tracks(tracks)).orderBy("rank").collect()
    assert [r["track_id"] for r in got] == [1, 2]  # the remix goes while there is another


def test_phases_choose_as_if_every_candidate_were_scored(spark):
    tracks = spark.createDataFrame(TRACKS, TRACK)
    said = [("Noche Azul", "Ana Ruiz"), ("Noche Azull", "Ana Ruiz"), ("Noche", None), (None, "Luis Mar"), ("Viento Nortes", "Luis Marr"), ("Noche Azul Remix", "Ana")]
    rows = [("p", i, f"{a or 'x'} - {t or 'y'} {i}.mp3", t, a, d) for i, (t, a, d) in enumerate((t, a, d) for t, a in said for d in (None, 199.0, 239.5))]
    e, lib, postings = normalise.normalise_entries(spark.createDataFrame(rows, ENTRY)), normalise.normalise_tracks(tracks), normalise.token_postings(tracks)
    found = {(r["eid"], r["track_id"], r["score"]) for r in scoring.match_by_tags(e, lib, postings).collect()}
    plain = scoring.best_by_tags(scoring.tag_score(blocking.tag_candidates(e, lib, postings))).where("fits")
    assert found and found == {(r["eid"], r["track_id"], r["score"]) for r in plain.collect()}
    named = {(r["eid"], r["track_id"], r["score"]) for r in scoring.match_by_name(e, lib, postings).collect()}
    plain = scoring.best_by_name(scoring.name_score(blocking.name_candidates(e, lib, postings)))
    assert named and named == {(r["eid"], r["track_id"], r["score"]) for r in plain.collect()}


def test_ratio_pairs_takes_all_pairs(spark, tmp_path):
    names = [f"name {i % 40}" for i in range(60)]
    spark.createDataFrame([(n,) for n in names], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    found = queries.ratio_pairs(spark, str(tmp_path))
    assert "Limit" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["a"], r["b"]) for r in found.collect()) == sorted((a, b) for a in set(names) for b in set(names))
    frame = spark.createDataFrame([(n,) for n in set(names)], "name string")
    assert sorted(map(tuple, queries.all_pairs(frame, 7).collect())) == sorted((a, b) for a in set(names) for b in set(names))


def test_best_match_name_serves_tagged_entries_that_tags_leave_open(spark, monkeypatch):
    rows = [
        ("p", 0, "D:/Pepe - Camino Largo.mp3", "Qqqq Zzzz", "Pepe", None),  # tags lead nowhere, the name does
        ("p", 1, "D:/Pepe - Camino Largo.mp3", None, None, None),
        ("p", 2, "D:/x.mp3", "Noche Azul", "Ana Ruiz", 200.0),  # by tags
    ]
    tracks, entries = spark.createDataFrame(TRACKS, TRACK), spark.createDataFrame(rows, ENTRY)
    monkeypatch.setattr(queries.A, "entries", lambda s, d: entries)
    monkeypatch.setattr(queries.A, "tracks", lambda s, d: tracks)
    forms = {r["eid"]: i for i, x in enumerate(rows) for r in normalise.normalise_entries(spark.createDataFrame([x], ENTRY)).collect()}
    got = {forms[r["eid"]]: r["track_id"] for r in queries.best_match_name(spark, "").collect()}
    assert got == {0: 5, 1: 5}


def test_upsert_keeps_the_last(spark):
    old = spark.createDataFrame([("k", "a", 1), ("l", "b", 2)], "key string, path string, bitrate int")
    new = spark.createDataFrame([("k", "c", 3, "p", 1), ("k", "d", 4, "p", 2)], "key string, path string, bitrate int, playlist string, pos int")
    once = caches.upsert(old, new, ["playlist", "pos"])
    assert {tuple(r) for r in once.collect()} == {("k", "d", 4), ("l", "b", 2)}
    assert {tuple(r) for r in caches.upsert(once, new, ["playlist", "pos"]).collect()} == {("k", "d", 4), ("l", "b", 2)}


def test_snapshot(spark):
    old = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0), ("c", 1, 1.0), ("d", None, None)], "path string, size long, mtime double")
    new = spark.createDataFrame([("A", 1, 1.00001), ("b", 2, 1.0), ("d", 5, 5.0), ("e", 1, 1.0)], "path string, size long, mtime double")
    assert {r["path"]: r["status"] for r in snapshot.snapshot_diff(old, new).collect()} == {"A": "reused", "b": "changed", "c": "deleted", "d": "reused", "e": "added"}
    assert [r["path"] for r in snapshot.deleted(old, new).collect()] == ["c"]


PLAYLIST = """\ufeff#EXTM3U
#EXTVDJ:<title>Lost</title>

#EXTVDJ:<filesize>7340032</filesize><lastplaytime>17.6</lastplaytime><artist>SomeVEVO</artist><title>Ana Ruiz - Noche Azul</title><remix>a</remix><Remix>Club</remix><REMIX>b</REMIX><songlength>201.5</songlength><Mood>calm</Mood>
# a comment
D:\\old\\Ana - Noche.mp3
netsearch://td12345678
D:\\odd<name>.mp3
notes.txt
#EXTVDJ:<songlength>x</songlength><title>T</title>
D:\\old\\Ana - Noche.mp3
"""


def test_playlist_parsing(spark, tmp_path):
    (tmp_path / "a.m3u").write_text(PLAYLIST, encoding="utf-8")
    (tmp_path / "b_actualizada.m3u").write_text("x.mp3\n")
    assert [r["path"].rsplit("/", 1)[1] for r in playlists.discover(spark, str(tmp_path)).collect()] == ["a.m3u"]
    rows = [r.asDict() for r in playlists.read_playlists(spark, str(tmp_path / "a.m3u")).orderBy("pos").collect()]
    assert [r["raw_path"] for r in rows] == ["D:\\old\\Ana - Noche.mp3", "netsearch://td12345678", "D:\\old\\Ana - Noche.mp3"]
    first, second, third = rows
    assert (first["title"], first["artist"], first["remix"], first["duration"], first["filesize"], first["lastplaytime"], first["extra"]) == ("Ana Ruiz - Noche Azul", "Ana Ruiz", "b", 201.5, 7340032, 17, {"mood": "calm"})
    assert second["title"] is None and not second["has_meta"] and third["title"] == "T" and third["duration"] is None


def test_repair_round_trip(spark, tmp_path):
    tracks = spark.createDataFrame(TRACKS, TRACK)
    version = library.write_snapshot(tracks, str(tmp_path / "lib"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "mix.m3u").write_text("#EXTM3U\n#EXTVDJ:<artist>Ana Ruiz</artist><title>Noche Azul</title><lastplaytime>9</lastplaytime><songlength>200.0</songlength>\nD:/gone.mp3\nD:/never heard.mp3\n")
    results, learned = repair(spark, str(tmp_path / "in"), version, str(tmp_path / "out"))
    assert {r["pos"]: r["phase"] for r in results.collect()} == {0: "identity", 1: "unmatched"}
    written = playlists.read_playlists(spark, [str(p) for p in (tmp_path / "out").glob("*.m3u")]).collect()
    assert [(r["raw_path"], r["artist"], r["lastplaytime"], r["duration"]) for r in written] == [(TRACKS[1][1], "Ana Ruiz", 9, 201.0)]
    again, _ = repair(spark, str(tmp_path / "in"), version, str(tmp_path / "out2"), learned=learned)
    assert {r["pos"]: r["phase"] for r in again.collect()}[0] == "memory_learned"


def test_library_refresh(spark, tmp_path):
    music = tmp_path / "music"
    music.mkdir()
    for name in ("Ana_Ruiz - Noche (live).mp3", "solo.FLAC", "cover.jpg"):
        (music / name).write_bytes(b"x")
    first = library.refresh_library(spark, str(music), str(tmp_path / "store"))
    tracks, postings = library.read_snapshot(spark, first)
    assert {(r["title"], r["artist"], r["auto_tags"]) for r in tracks.collect()} == {("Noche", "Ana Ruiz", True), ("solo", None, True)}
    assert {r["token"] for r in postings.where("token_type = 'title'").collect()} == {"noche", "solo"}
    assert library.refresh_library(spark, str(music), str(tmp_path / "store"), first) == first
    (music / "new - song.wav").write_bytes(b"y")
    second = library.refresh_library(spark, str(music), str(tmp_path / "store"), first)
    assert second != first and library.read_snapshot(spark, second)[0].count() == 3


def test_tags_of_names(spark):
    rows = [("x/a.mp3", "Ana - Ana: Noche", None, ("Noche", "Ana", True)), ("x/a.mp3", "T", "A", ("T", "A", False)), ("x/A_b - c [d] - e.mp3", None, None, ("c- e", "A b", True))]
    for path, title, artist, expected in rows:
        df = spark.createDataFrame([(path, title, artist)], "p string, t string, a string")
        assert tuple(df.select(*library.tags_of_name(F.col("p"), F.col("t"), F.col("a"))).first()) == expected


def test_state_files(spark, tmp_path):
    (tmp_path / "manual.json").write_text(json.dumps({"exact|a": "C:/x.mp3"}))
    (tmp_path / "broken.json").write_text("[1")
    (tmp_path / "alias.json").write_text(json.dumps({"artist_alias": {"El Ana": "ana", " ": "x"}, "rules": {"normalize_diminutives": True}}))
    assert [tuple(r) for r in state.read_manual(spark, str(tmp_path / "manual.json")).collect()] == [("exact|a", "C:/x.mp3")]
    assert state.read_manual(spark, str(tmp_path / "broken.json")).collect() == []
    assert [tuple(r) for r in state.read_aliases(spark, str(tmp_path / "alias.json")).collect()] == [("El Ana", "ana")]
    state.write_manual(spark.createDataFrame([("exact|a", "b"), ("norm|a", "b")], "key string, path string"), str(tmp_path / "out"))
    assert state.read_manual(spark, str(tmp_path / "out")).count() == 2


def test_alias_mining(spark):
    rows = [(1, "Ana y Luis", "Noche", 100.0), (2, "Luis & Ana", "Noche", 100.2), (3, "Ana y Luis", "Otra", 50.0), (4, "Solo", "x", 1.0), (5, None, "x", 1.0)]
    tracks = spark.createDataFrame(rows, "track_id long, artist string, title string, duration double")
    got = alias.suggestions(tracks).collect()
    assert [(r["variant"], r["canonical"], r["occurrences"], r["examples"]) for r in got] == [("Luis & Ana", "Ana y Luis", 1, ["noche"])]
    assert "shared titles" in got[0]["reasons"]
    none = spark.createDataFrame([], "variant string, canonical string")
    accepted = alias.suggestions(tracks).select("variant", "canonical")
    table = alias.apply_aliases(none, accepted)
    assert [tuple(r) for r in table.collect()] == [("Luis & Ana", "Ana y Luis")]
    assert alias.apply_aliases(table, accepted).count() == 1 and alias.prune(alias.suggestions(tracks), accepted).count() == 0
    assert alias.pending(alias.suggestions(tracks), none, least=0.0, query="LUIS &").count() == 1 and alias.pending(alias.suggestions(tracks), accepted, least=0.0).count() == 0


def test_metrics(spark):
    s = spark.createDataFrame([(1, "a", True, 1.0, False, 5), (2, "a", False, 3.0, True, 5), (3, "b", True, 2.0, False, 5)], "seq long, phase string, found boolean, elapsed double, full_scan boolean, index_size long")
    r = metrics.run_summary(s).first()
    assert (r["entries"], r["found"], r["full_scans"], r["p50"], r["slowest"], r["per_second"]) == (3, 2, 1, 2.0, 3.0, 0.5)
    assert [x["phase"] for x in metrics.phase_summary(s).collect()] == ["a", "b"] and metrics.slowest(s, 1).first()["seq"] == 2
    shown = spark.range(1).select(metrics.percent(F.lit(1), F.lit(3)), metrics.clock_label(F.lit(125_000)), metrics.bitrate_label(F.lit(320))).first()
    assert tuple(shown) == (33, "02:05", "320 kbps")


def test_streamed_playlists(spark, tmp_path):
    from cratebind.streaming.inbox import watch

    version = library.write_snapshot(spark.createDataFrame(TRACKS, TRACK), str(tmp_path / "lib"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.m3u").write_text(f"{TRACKS[0][1]}\nD:/never heard.mp3\n")
    watch(spark, str(tmp_path / "in"), version, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert sorted(r["phase"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["unmatched", "valid_path"]


def test_repairs_of_reading_and_writing(spark, tmp_path):
    lines = spark.createDataFrame([("p", 0, "\t a.mp3\t"), ("p", 1, "#EXTVDJ:<title>\tT </title>"), ("p", 2, "b.mp3 ")], "playlist string, line_no int, line string")
    assert [(r["raw_path"], r["title"]) for r in playlists.entries_of_lines(lines).orderBy("pos").collect()] == [("a.mp3", None), ("b.mp3", "T")]
    rows = spark.createDataFrame([("/x/a/mix.m3u", 0, "#m", "one.mp3"), ("/x/b/mix.m3u", 0, "#m", "two.mp3")], "playlist string, pos int, meta string, path string")
    with pytest.raises(ValueError):
        playlists.write_playlists(rows, str(tmp_path / "flat"))
    playlists.write_playlists(rows, str(tmp_path / "kept"), "/x")
    assert (tmp_path / "kept/a/mix_actualizada.m3u").read_text() == "#EXTM3U\n#m\none.mp3\n" and (tmp_path / "kept/b/mix_actualizada.m3u").exists()
    assert not list((tmp_path / "kept").glob(".staging*"))
    said = spark.createDataFrame([(f"v{i}", "v", "c", "c", 0.5, ["r"], 1, ["e"]) for i in range(6)], "variant string, variant_norm string, canonical string, canonical_norm string, confidence double, reasons array<string>, occurrences bigint, examples array<string>")
    state.write_suggestions(said.coalesce(1), str(tmp_path / "s"))
    assert state.read_suggestions(spark, str(tmp_path / "s")).count() == 6
    (tmp_path / "s.json").write_text(json.dumps([{"variant": "a"}, {"variant": "b"}]))
    assert state.read_suggestions(spark, str(tmp_path / "s.json"), imported=True).count() == 2


def test_overrides_hold_for_their_playlist_alone(spark):
    entries = [("a", 0, TRACKS[0][1], "Noche Azul", "Ana Ruiz", 200.0), ("b", 0, TRACKS[0][1], "Noche Azul", "Ana Ruiz", 200.0)]
    df = spark.createDataFrame(entries, "playlist string, pos int, raw_path string, title string, artist string, duration double")
    own = spark.createDataFrame([("a", TRACKS[0][1], 320)], "playlist string, path string, bitrate int")
    tracks = spark.createDataFrame(TRACKS, TRACK)
    got = {r["playlist"]: r for r in match(df, tracks, normalise.token_postings(tracks), overrides=own, only_low_bitrate=True).collect()}
    assert got["a"]["phase"] == "valid_path" and got["a"]["bitrate"] == 320 and got["b"]["phase"] == "identity"
    got = {r["playlist"]: r for r in match(df, tracks, normalise.token_postings(tracks), overrides=own).collect()}
    assert got["a"]["bitrate"] == 320 and got["b"]["bitrate"] == TRACKS[0][5]


def test_keys_and_forms_of_odd_texts(spark):
    from cratebind.functions import text as T

    df = spark.createDataFrame([("a|~", None, "x"), ("a", "~|", "x"), ("a", None, "~|x")], "artist string, title string, raw_path string").withColumn("duration", F.lit(None).cast("double"))
    assert df.select(normalise.entry_id()).distinct().count() == 3
    rows = spark.createDataFrame([("Song\u2026 \ufb01n \u2122 \u00bd",)], "t string").select(T.norm(F.col("t"))).first()
    assert rows[0] == "song... fin tm 1\u20442"


def test_review_options_and_readiness(spark, tmp_path):
    from cratebind.operators import metrics, review
    from cratebind.sources import options

    results = spark.createDataFrame([("p", i, f"r{i}", "unmatched", False, None) for i in range(4)], "playlist string, pos int, raw_path string, phase string, found boolean, path string")
    said = spark.createDataFrame([("p", 0, "choose", "c.mp3"), ("p", 1, "valid", None), ("p", 2, "skip", None)], "playlist string, pos int, action string, path string")
    got = [(r["phase"], r["found"], r["path"]) for r in review.in_order(review.resolve(results, said)).collect()]
    assert got == [("manual", True, "c.mp3"), ("valid_path", True, "r1"), ("skipped", False, None), ("unmatched", False, None)]
    picks = spark.createDataFrame([("Ana - Noche", "x/Ana - Noche.mp3"), ("Ana - Noche", "x/zzz.mp3")], "l string, p string")
    assert [r[0] for r in picks.select(review.needs_confirmation(F.col("l"), F.col("p"))).collect()] == [False, True]
    tracks = normalise.normalise_tracks(spark.createDataFrame(TRACKS, TRACK))
    entry = normalise.normalise_entries(spark.createDataFrame([("D:/x.mp3", "Noche Azul", "Ana Ruiz", 200.0)], "raw_path string, title string, artist string, duration double"))
    scored = review.score_choice(entry.crossJoin(spark.createDataFrame([(TRACKS[0][1],), ("gone.mp3",)], "path string")), tracks)
    assert {r["path"]: r["score"] for r in scored.collect()} == {TRACKS[0][1]: 100.0, "gone.mp3": 0.0}
    options.write_options(spark, options.Options(threshold=80, folder_path="/m"), str(tmp_path / "o"))
    found = options.read_options(spark, str(tmp_path / "o"))
    assert (found.threshold, found.folder_path) == (80, "/m") and options.read_options(spark, str(tmp_path / "none")) == options.Options()
    assert [r["path"] for r in options.selected_playlists(spark, found, ["a"]).collect()] == ["a"] and options.selected_playlists(spark, found).collect() == []
    version = library.write_snapshot(spark.createDataFrame(TRACKS, TRACK), str(tmp_path / "lib"))
    assert library.ready(spark, version) and not library.ready(spark, str(tmp_path / "v1-x")) and not library.ready(spark, str(tmp_path / "v2-x"))
    assert options.purge(spark, version, str(tmp_path / "none")) == [version] and not library.ready(spark, version)
    stats = spark.createDataFrame([(i, "tags", True, 0.5 * i, False, 9) for i in range(3)], "seq long, phase string, found boolean, elapsed double, full_scan boolean, index_size long")
    metrics.write_report(stats, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == 5


def copies(spark, n):
    """Tracks in n copies each under other paths, and entries of theirs."""
    rows = [(i + 10 * k, f"C:/m/{k}/{p.rsplit('/', 1)[1]}", t, a, d, b, auto) for k in range(n) for i, p, t, a, d, b, auto in TRACKS]
    said = [("p", i, f"D:/{i % 2}/x{i}.mp3", t, "Ana Ruiz", d) for i, (t, d) in enumerate((t, d) for t in ("Noche Azul", "Viento Norte") for d in (None, 199.0, 203.0, 230.0))]
    tracks = spark.createDataFrame(rows, TRACK)
    return tracks, normalise.normalise_tracks(tracks), normalise.normalise_entries(spark.createDataFrame(said, ENTRY))


def test_copies_of_tracks_make_no_more_candidates(spark):
    tracks, lib, entries = copies(spark, 6)
    kinds = normalise.foremost(tracks)
    assert sorted((r["track_id"], r["alike"]) for r in kinds.collect()) == [(i, 6) for i in (1, 2, 3, 4, 5)]
    few, postings = normalise.normalise_tracks(kinds), normalise.token_postings(kinds)
    plain = identity.similar_join(entries, lib)
    row = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    counted = plain.groupBy("eid").agg(F.count("*").alias("pairs"), F.max("t_bitrate").alias("best_bitrate"))
    assert row(counted, "eid", "pairs", "best_bitrate") == row(identity.similar_counts(entries, lib), "eid", "pairs", "best_bitrate") != []
    assert row(identity.alike(plain), "eid", "track_id", "t_bitrate") == row(identity.similar_best(entries, few), "eid", "track_id", "t_bitrate")
    from cratebind.plans.cascade import alias_best

    blocked = identity.alias_best(blocking.tag_candidates(entries, lib, normalise.token_postings(tracks)))
    assert row(blocked, "eid", "track_id", "t_bitrate") == row(alias_best(entries, few, postings, 3.0), "eid", "track_id", "t_bitrate") != []
    assert row(identity.identity_best(lib), *identity.KEY, "best_all", "best_real") == row(identity.identity_best(few), *identity.KEY, "best_all", "best_real")


def test_blocks_are_of_kinds_not_of_tracks(spark):
    tracks, _, entries = copies(spark, 6)
    postings = normalise.token_postings(tracks)
    index = blocking.track_kinds(postings)
    assert blocking.tag_kinds(entries, index).count() * 6 <= blocking.tag_blocks(entries, postings).count()
    sets = {(r["sid"]): (set(r["title_tokens"]), set(r["artist_tokens"])) for r in entries.select(blocking.set_id(*blocking.SETS).alias("sid"), *blocking.SETS).collect()}
    of = {}
    for r in postings.collect():
        of.setdefault(r["track_id"], {}).setdefault(r["token_type"], set()).add(r["token"])
    want = set()
    for sid, (title, artist) in sets.items():
        hit = {i: (bool(title & x.get("title", set())), bool(artist & x.get("artist", set()))) for i, x in of.items()}
        both = {i for i, h in hit.items() if all(h)}
        want |= {(sid, i) for i in (both or {i for i, h in hit.items() if any(h)})}
    assert {(r["sid"], r["track_id"]) for r in blocking.tag_blocks(entries, postings).collect()} == want


def test_tag_choice_meets_durations_not_tracks(spark):
    rows = [(i, f"C:/{i}/Ana - Noche Azul.mp3", "Noche Azul", "Ana", None if i == 7 else 150.0 + i % 40 / 2, (128, 192, 320)[i % 3], i % 5 == 0) for i in range(120)]
    tracks = spark.createDataFrame(rows, TRACK)
    said = [("p", i, f"D:/x{i}.mp3", "Noche Azul", "Ana", d) for i, d in enumerate((None, 10.0, 149.9, 155.25, 160.0, 900.0))]
    entries, lib, postings = normalise.normalise_entries(spark.createDataFrame(said, ENTRY)), normalise.normalise_tracks(tracks), normalise.token_postings(tracks)
    sayings = scoring.Sayings(entries, lib, postings)
    assert sayings.placed.count() == 1
    plain = scoring.best_by_tags(scoring.tag_score(blocking.tag_candidates(entries, lib, postings)))
    got = {(r["eid"], r["track_id"], r["score"]) for r in scoring.match_by_tags(entries, lib, postings).collect()}
    assert got == {(r["eid"], r["track_id"], r["score"]) for r in plain.where("fits").collect()} and len(got) == 6


def test_names_meet_in_cells_and_leave_only_what_can_be_nearest(spark, monkeypatch):
    import random

    from cratebind.functions.similarity import plain_ratio

    made = {}
    whole = scoring.stored
    monkeypatch.setattr(scoring, "stored", lambda df, name: made.setdefault(name, whole(df, name)))
    draw, words = random.Random(1), ["ana", "rio", "sol", "luz", "mar", "noche", "azul", "viento", "largo", "x1"]
    asked, borne = (sorted({" ".join(draw.sample(words, draw.randint(1, 4))) for _ in range(n)}) for n in (40, 60))
    posted = {name: set(draw.sample(words, 3)) for name in borne}
    mine = spark.createDataFrame([(n, t) for n in asked for t in n.split()], "name_norm string, token string")
    theirs = [(n, t, True, False) for n in borne for t in posted[n]] + [(n, t, False, True) for n in borne for t in n.split()]
    found = {}
    for r in scoring.nearest_names(mine, spark.createDataFrame(theirs, "t_name_norm string, token string, posted boolean, own boolean"), 3, 6, few=7, more=5).collect():
        assert (r["name_norm"], r["t_name_norm"]) not in found
        found[r["name_norm"], r["t_name_norm"]] = r["ratio"]
    every = {(a, b): plain_ratio(a, b) for a in asked for b in borne if set(a.split()) & posted[b] and set(a.split()) & set(b.split())}
    for a in asked:
        best = sorted((r for (x, _), r in every.items() if x == a), reverse=True)
        bar = best[2] if len(best) > 2 else 0.0
        assert {p: r for p, r in every.items() if p[0] == a and r >= bar} == {p: r for p, r in found.items() if p[0] == a and r >= bar}
    assert all(df.count() < len(every) / 2 for name, df in made.items() if name in ("first-ratios", "more-ratios"))


def test_candidates_of_entries_without_duration_reach_without_it(spark, monkeypatch):
    made = []
    whole = ranking.stored
    monkeypatch.setattr(ranking, "stored", lambda df, name: made.append((name, whole(df, name))) or made[-1][1])
    tracks = spark.createDataFrame([(1, "C:/Noche Azul.mp3", "Noche Azul", "Ana Ruiz", 200.0, 128, False), (2, "C:/Ana Ruis - Viento.mp3", "Viento", "Ana Ruis", 200.0, 320, False)], TRACK)
    entries = spark.createDataFrame([("p", 0, "D:/a.mp3", "Noche Azul", "Ana Ruiz", None)], ENTRY)
    rows = ranking.top_candidates(normalise.normalise_entries(entries), normalise.normalise_tracks(tracks), 1).collect()
    assert [(r["track_id"], r["score"]) for r in rows] == [(1, 80.0)]
    # the other track's artist gives 70 * 0.875, and 25 only with a duration
    assert [df.count() for name, df in made if name == "texts"][2:] == [0, 0]
