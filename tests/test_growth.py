"""Steps whose cost is to grow no faster than the input."""

from pyspark.sql import functions as F

from cratebind.operators import normalise
from cratebind.plans import queries

ENTRY = "playlist long, pos int, raw_path string, title string, artist string, duration double"
ROWS = [
    (1, 0, "C:/a/Ana - Sol.mp3", "Sol", "Ana", 200.0), (1, 1, "D:/b/Ana - Sol.mp3", "Sol (HD)", "Ana", 200.0), (2, 0, "C:/a/Ana - Sol.mp3", "Sol", "Ana", 200.0),
    (3, 5, "x.mp3", None, None, None), (3, 6, "x.mp3", None, None, None), (4, 0, "y.mp3", "", None, -0.0), (4, 1, "y.mp3", "", None, 0.0), (-7, 9, "C:/a/Ana - Sol.mp3", "Sol", "Ana", None),
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_distinct_entries_are_hashed_and_keep_their_ids(spark):
    rows = spark.createDataFrame(ROWS, ENTRY)
    found = normalise.distinct_entries(rows, F.max("pos").alias("last"))
    ids = {r["eid"] for r in rows.select(normalise.entry_id().alias("eid")).collect()}
    assert {r["eid"] for r in found.collect()} == ids and found.count() == len(ids) == 6
    again = found.select("eid", normalise.entry_id().alias("own")).collect()
    assert all(r["eid"] == r["own"] for r in again)
    assert {r["name"]: r["last"] for r in found.where("raw_path = 'x.mp3'").collect()} == {"x.mp3": 6}
    assert "SortAggregate" not in plan(found) and "SortAggregate" not in plan(normalise.distinct_entries(rows))


def test_derived_equality_works_out_no_tags_of_entries(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("file names alone are asked")

    monkeypatch.setattr(normalise, "tag_forms", refuse)
    assert queries.derived_equality(spark, "/root/testdata/sf0.001").take(1)


def test_last_learned_is_what_all_rows_would_leave(spark):
    from cratebind.operators import caches

    rows = spark.createDataFrame(ROWS, ENTRY)
    forms = normalise.normalise_entries(rows).select("eid", "artist_norm", "canon", "name_norm")
    place = F.col("playlist").cast("decimal(20,0)") * F.lit(1 << 32) + F.col("pos")
    matches = normalise.distinct_entries(rows, F.max(place).alias("place"), F.max_by("pos", place).alias("bitrate")).withColumn("path", F.concat("raw_path", F.lit("|"), "place"))
    whole = matches.join(forms, "eid").select("*", F.col("place").alias("pos"))
    none = spark.createDataFrame([], "key string, path string, bitrate int")
    every = {tuple(r) for r in caches.upsert(none, caches.learned_rows(whole), ["pos"]).collect()}
    tags = normalise.tag_forms(matches.select("title", "artist").distinct()).select("title", "artist", "artist_norm", "canon")
    names = normalise.name_forms(matches.select("name").distinct()).select("name", "name_norm")
    last = caches.last_learned(matches, tags, names)
    assert {tuple(r) for r in caches.upsert(none, last, ["place"]).collect()} == every and len(every) > 9
    assert last.count() == len(every)


def test_large_tables_are_not_sent_to_the_driver(spark):
    from cratebind.plans import adapters

    few, many = spark.range(50), spark.range(200)
    assert "BroadcastHashJoin" in plan(few.join(adapters.met_in_parts(many), "id"))
    assert "BroadcastHashJoin" not in plan(few.join(adapters.met_in_parts(many, 100).select("id"), "id"))


def test_paths_of_a_large_library_are_met_in_parts(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(queries.A, "met_in_parts", lambda df: asked.append(df) or df.hint("merge"))
    queries.identity_best(spark, "/root/testdata/sf0.001")
    assert len(asked) == 1
    assert "BroadcastHashJoin" not in plan(queries.kinds_of(spark, "/root/testdata/sf0.001"))


def test_stored_frames_of_many_rows_are_met_in_parts(spark):
    """A column of few values takes next to nothing in a file, and much in each row that is sent."""
    from cratebind.operators.storage import stored

    wide = spark.range(20_000_000)
    many = spark.range(150_000).select((F.col("id") % 3).alias("id"), F.lit("x" * 60).alias("text"))
    kept, few = stored(many, "many"), stored(many.limit(50), "few")
    assert kept.count() == 150_000 and few.count() == 50 and stored(many.limit(0), "none").count() == 0
    assert "BroadcastHashJoin" not in plan(wide.join(kept.where("id > 0"), "id"))
    assert "BroadcastHashJoin" in plan(wide.join(few, "id"))


def test_paths_are_worked_out_before_they_are_sorted(spark, monkeypatch):
    """A sort by an expression asks for it at each comparison."""
    import pytest

    from cratebind.plans import adapters, cascade

    class Seen(Exception):
        pass

    def seen(df, name):
        if name == "valid-paths":
            raise Seen(plan(df))
        return df.hint("merge")

    monkeypatch.setattr(cascade, "stored", seen)
    tracks = adapters.tracks(spark, "/root/testdata/sf0.001")
    with pytest.raises(Seen) as found:
        cascade.match(spark.createDataFrame(ROWS, ENTRY), tracks, normalise.token_postings(tracks))
    keys = [line for line in str(found.value).splitlines() if "SortMergeJoin" in line or " Sort [" in line]
    assert len(keys) >= 6 and not any("regexp_replace" in line for line in keys)


def test_texts_that_others_are_sure_to_beat_meet_no_tracks(spark):
    from cratebind.operators import ranking

    top = object.__new__(ranking.TagRanking)
    top.k = 3
    top.cells = spark.createDataFrame([("a", "x", False), ("a", "x", False), ("b", "x", False), ("b", "x", True), ("c", "x", False), ("d", "x", False), ("e", "x", True)], "t_title_norm string, t_artist_norm string, t_remix boolean")
    bases = {"a": 90.0, "b": 80.0, "c": 61.0, "d": 59.0, "e": 85.0}
    pairs = spark.createDataFrame([("p", "x", t, "x", b, 20.0) for t, b in bases.items()] + [("q", "x", "a", "x", 5.0, 20.0), ("q", "x", "d", "x", 0.0, 20.0)], "pure_norm string, artist_norm string, t_title_norm string, t_artist_norm string, base double, most double")
    got = {(r["pure_norm"], r["t_title_norm"]): r["first"] for r in top.foremost_texts(pairs).collect()}
    # the third track that is no remix has a base of 80; with a duration d gets to 79 at most
    assert got == {("p", "a"): True, ("p", "b"): True, ("p", "e"): True, ("p", "c"): False, ("q", "a"): True, ("q", "d"): True}
