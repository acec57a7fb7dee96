"""Embedded tags of hand-made files, playlist files with awkward names, what exists on disk, paths."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from cratebind.functions import text as T
from cratebind.operators import caches, normalise, review
from cratebind.plans.cascade import match
from cratebind.plans.repair import preview, repair, repair_as_set
from cratebind.sources import library, options, playlists, tags

from .test_engine import ENTRY, TRACK, TRACKS


def sync(n):
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def id3(version, frames, flags=0):
    body = b""
    for name, data in frames:
        size = len(data).to_bytes(3, "big") if version == 2 else sync(len(data)) if version == 4 else len(data).to_bytes(4, "big")
        body += name + size + (b"" if version == 2 else b"\0\0") + data
    return b"ID3" + bytes([version, 0, flags]) + sync(len(body) + 20) + body + bytes(20)


def box(name, data):
    return (len(data) + 8).to_bytes(4, "big") + name + data


def comments(**said):
    items = [f"{k}={v}".encode() for k, v in said.items()]
    return struct.pack("<I", 4) + b"mine" + struct.pack("<I", len(items)) + b"".join(struct.pack("<I", len(i)) + i for i in items)


def files():
    frame = b"\xff\xfb\x90\x00"  # MPEG 1 layer III, 128 kbit/s, 44.1 kHz
    sound = frame + bytes(160_000 - 4)
    xing = frame + bytes(32) + b"Xing" + struct.pack(">III", 3, 1000, 400_000) + bytes(1000)
    picture = (b"APIC", bytes(300_000))
    out = {
        "a b %20 + ü.mp3": id3(3, [picture, (b"TIT2", b"\x01" + "Niña".encode("utf-16")), (b"TPE1", b"\0Ana Ruiz\0Other")]) + sound,
        "four.mp3": id3(4, [(b"TIT2", b"\x03Four"), (b"TPE1", b"\x03Q")]) + sound,
        "two.mp3": id3(2, [(b"TT2", b"\0Two"), (b"TP1", b"\0Who")]) + xing,
        "old.mp3": sound + b"TAG" + b"Old song".ljust(30, b"\0") + b"Old artist".ljust(30, b"\0") + bytes(65),
        "Ana Ruiz - Bare (live).mp3": sound,
        "s.flac": b"fLaC" + b"\0" + (34).to_bytes(3, "big") + bytes(10) + (44100 << 44 | 1 << 41 | 15 << 36 | 441_000).to_bytes(8, "big") + bytes(16)
        + b"\x84" + len(comments(TITLE="Flac", ARTIST="F")).to_bytes(3, "big") + comments(TITLE="Flac", ARTIST="F") + bytes(100_000),
        "w.wav": b"",
        "broken.mp3": b"\x01\x02",
        "broken.flac": b"fLaC\0\xff",
        "short.m4a": b"\0",
        "note.txt": b"no music",
    }
    tag = id3(3, [(b"TIT2", b"\0Wave"), (b"TPE1", b"\0W")])
    body = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 44100, 176_400, 4, 16) + b"data" + struct.pack("<I", 352_800) + bytes(352_800) + b"id3 " + struct.pack("<I", len(tag)) + tag
    out["w.wav"] = b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body
    text = lambda name, t: box(name, box(b"data", struct.pack(">II", 1, 0) + t))
    esds = box(b"esds", bytes(4) + b"\x03\x19\0\0\0" + b"\x04\x11\x40\x15" + bytes(3) + struct.pack(">II", 300_000, 256_000))
    entry = box(b"mp4a", bytes(28) + esds)
    stsd = box(b"stsd", struct.pack(">II", 0, 1) + entry)
    track = box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", stsd))))
    movie = box(b"mvhd", struct.pack(">IIIII", 0, 0, 0, 1000, 12_500) + bytes(80)) + track + box(b"udta", box(b"meta", bytes(4) + box(b"ilst", text(b"\xa9nam", b"Four") + text(b"\xa9ART", b"M"))))
    out["m.m4a"] = box(b"ftyp", b"M4A ") + box(b"mdat", bytes(5000)) + box(b"moov", movie)
    return out


def test_embedded_tags(spark, tmp_path):
    for name, data in files().items():
        (tmp_path / name).write_bytes(data)
    listing = library.list_audio(spark, str(tmp_path))
    got = {os.path.basename(r["path"]): r for r in library.tracks_of_files(library.read_tags(listing)).collect()}
    assert set(got) == {n for n in files() if not n.endswith(".txt")}
    seen = {n: (r["title"], r["artist"], r["auto_tags"], r["bitrate"]) for n, r in got.items()}
    assert seen["a b %20 + ü.mp3"] == ("Niña", "Ana Ruiz", False, 128) and abs(got["a b %20 + ü.mp3"]["duration"] - 10.0) < 0.01
    assert seen["four.mp3"] == ("Four", "Q", False, 128)
    assert seen["two.mp3"] == ("Two", "Who", False, 122) and abs(got["two.mp3"]["duration"] - 1000 * 1152 / 44100) < 1e-6
    assert seen["old.mp3"] == ("Old song", "Old artist", False, 128) and abs(got["old.mp3"]["duration"] - 10.0) < 0.01
    assert seen["Ana Ruiz - Bare (live).mp3"] == ("Bare", "Ana Ruiz", True, 128)
    assert seen["s.flac"] == ("Flac", "F", False, 80) and got["s.flac"]["duration"] == 10.0
    assert seen["w.wav"] == ("Wave", "W", False, 1411) and got["w.wav"]["duration"] == 2.0
    assert seen["m.m4a"] == ("Four", "M", False, 256) and got["m.m4a"]["duration"] == 12.5
    for name in ("broken.mp3", "broken.flac", "short.m4a"):
        assert got[name]["duration"] is None and got[name]["auto_tags"]


def test_only_parts_of_a_file_are_read(tmp_path):
    name = tmp_path / "big.mp3"
    name.write_bytes(files()["a b %20 + ü.mp3"] + bytes(5_000_000))
    read = []
    size, take, close = tags.ranges_of(str(name))
    assert tags.mp3(lambda at, n: read.append(n) or take(at, n), size)["title"] == "Niña"
    close()
    assert sum(read) < 3 * tags.MOST


def test_refresh_reads_changed_files_alone(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("four.mp3", "old.mp3"):
        (tmp_path / "in" / name).write_bytes(files()[name])
    first = library.refresh_library(spark, str(tmp_path / "in"), str(tmp_path / "lib"))
    assert library.refresh_library(spark, str(tmp_path / "in"), str(tmp_path / "lib"), first) == first
    (tmp_path / "in" / "s.flac").write_bytes(files()["s.flac"])
    (tmp_path / "in" / "old.mp3").unlink()
    second = library.refresh_library(spark, str(tmp_path / "in"), str(tmp_path / "lib"), first)
    assert {r["title"] for r in library.read_snapshot(spark, second)[0].collect()} == {"Four", "Flac"}


def test_playlists_with_awkward_names_go_where_they_belong(spark, tmp_path):
    lists = {"one/My List + 100%.m3u": f"#EXTM3U\n{TRACKS[0][1]}\n", "one/mix.m3u": "D:/never heard.mp3\n", "two/mix.m3u8": f"{TRACKS[4][1]}\n", "two/nothing.m3u": "#EXTM3U\n", "two/mix_actualizada.m3u": "old.mp3\n"}
    for name, text in lists.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    version = library.write_snapshot(spark.createDataFrame(TRACKS, TRACK), str(tmp_path / "lib"))
    said = options.Options(batch_playlists_root=str(tmp_path / "in"), dest_mode="folder", dest_folder=str(tmp_path / "out"), keep_structure=True)
    repair_as_set(spark, said, version)
    made = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert set(made) == {"one/My List + 100%_actualizada.m3u", "one/mix_actualizada.m3u", "two/mix_actualizada.m3u", "two/nothing_actualizada.m3u"}
    assert made["one/mix_actualizada.m3u"] == made["two/nothing_actualizada.m3u"] == "#EXTM3U\n"
    assert made["two/mix_actualizada.m3u"].endswith(TRACKS[4][1] + "\n")
    again = playlists.media_lines_of(spark, str(tmp_path / "out" / "one")).collect()
    assert [(os.path.basename(r["playlist"]), r["line"]) for r in again] == [("My List + 100%_actualizada.m3u", TRACKS[0][1])]
    with pytest.raises(ValueError):  # two lists of one name
        repair(spark, str(tmp_path / "in"), version, str(tmp_path / "flat"), recursive=True)
    assert not (tmp_path / "flat").exists()
    repair(spark, str(tmp_path / "in" / "one"), version, None)
    assert (tmp_path / "in" / "one" / "My List + 100%_actualizada.m3u").exists()


def test_output_folders_are_compared_without_schemes(spark):
    rows = [("file:///x/a/mix.m3u", "/x"), ("file:/x/a/mix.m3u", "file:///x/"), ("hdfs://h:9/x/a/mix.m3u", "hdfs://h:9/x"), ("/x/a/mix.m3u", "file:/x"), ("/y/mix.m3u", "/x")]
    got = [spark.createDataFrame([(p,)], "p string").select(playlists.output_path(F.col("p"), "/out", r)).first()[0] for p, r in rows]
    assert got == ["/out/a/mix_actualizada.m3u"] * 4 + ["/out/mix_actualizada.m3u"]


def test_existence_is_what_the_listing_says(spark):
    tracks = spark.createDataFrame(TRACKS, TRACK)
    entries = spark.createDataFrame([("p", 0, "D:/own/outside.mp3", None, None, None), ("p", 1, TRACKS[0][1], "Noche Azul", "Ana Ruiz", 200.0), ("p", 2, "D:/gone/by hand.mp3", None, None, None), ("p", 3, "D:/gone/tagged.mp3", "Qqqq", "Zzzz", None)], ENTRY)
    listing = spark.createDataFrame([("d:\\own\\.\\OUTSIDE.mp3",), (TRACKS[1][1],), ("E:/by hand (2).mp3",)], "path string")
    chosen = caches.manual_rows(spark.createDataFrame([("D:/gone/by hand.mp3", "E:/by hand (2).mp3"), ("D:/gone/tagged.mp3", "E:/by hand (2).mp3")], "label string, path string"))
    postings = normalise.token_postings(tracks)
    got = {r["pos"]: r for r in match(entries, tracks, postings, chosen, listing=listing).collect()}
    assert got[0]["phase"] == "valid_path" and got[0]["bitrate"] == 0  # a file outside the library
    assert got[1]["phase"] == "identity" and got[1]["path"] == TRACKS[1][1]  # a track whose file is gone does not stand
    assert got[2]["phase"] == "memory_manual" and got[2]["path"] == "E:/by hand (2).mp3"
    assert got[3]["phase"] == "unmatched"  # with tags, a choice by hand has to be a track
    seen = {r["pos"]: (r["route_valid"], r["bitrate"]) for r in preview(entries, tracks, listing).collect()}
    assert seen == {0: (True, 0), 1: (False, 0), 2: (False, 0), 3: (False, 0)}


def test_paths_are_folded(spark):
    pairs = {
        "C:\\A\\.\\b//c/": "c:/a/b/c", "a/b/../../c": "c", "../a": "../a", "../../a/../b": "../../b", "/../a": "/a", "C:/../a": "c:/a", "a/./b/..": "a",
        "/x/..": "/", "a..b/...": "a..b/...", "//srv/share/x": "/srv/share/x", "x/..": "",
    }
    df = spark.createDataFrame([(p,) for p in pairs], "p string")
    assert {r[0]: r[1] for r in df.select("p", T.norm_path(F.col("p"))).collect()} == pairs


def test_choices_by_hand_are_scored_as_tags_are(spark):
    tracks = normalise.normalise_tracks(spark.createDataFrame(TRACKS, TRACK))
    form = "raw_path string, title string, artist string, duration double, path string"
    rows = [("D:/x.mp3", "Noche Azul", "Ana Ruiz", 220.0, TRACKS[0][1]), ("D:/Ana Ruiz - Noche Azul.mp3", None, None, None, TRACKS[0][1]), ("D:/qqqq.mp3", None, None, None, TRACKS[0][1])]
    said = spark.createDataFrame(rows, form)
    entries = normalise.normalise_entries(said).join(said.select("raw_path", "path"), "raw_path")
    got = {r["raw_path"]: r["score"] for r in review.score_choice(entries, tracks).join(entries.select("eid", "raw_path"), "eid").collect()}
    assert got == {"D:/x.mp3": 80.0, "D:/Ana Ruiz - Noche Azul.mp3": 100.0, "D:/qqqq.mp3": 0.0}
    asked = spark.createDataFrame([("D:/one.mp3", "E:/one.mp3"), ("D:/one two.mp3", "E:/one two.flac"), ("D:/one.mp3", "E:/other.wav")], "a string, b string")
    assert [r[0] for r in asked.select(review.needs_confirmation(F.col("a"), F.col("b"))).collect()] == [False, False, True]
