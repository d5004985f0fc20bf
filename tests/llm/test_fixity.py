from pyspark.sql import functions as F
from tidewheel.llm import fixity

SCHEMA = "archive string, offset long, id long, record string, status int"


def audit(spark, left, right):
    a, b = (spark.createDataFrame([(*r, 0) for r in rows], SCHEMA) for rows in (left, right))
    return sorted((r.archive, r.offset, r.id, r.status) for r in fixity.audit(a, b).collect())


def test_every_kind_of_damage_is_found_and_nothing_else(spark, monkeypatch):
    monkeypatch.setattr(fixity, "RANGE_BYTES", 16)
    monkeypatch.setattr(fixity, "FAN", 2)
    sound = [(a, 10 * i, i, f"{a} record {i}") for a in ("a", "b", "c") for i in range(40)]
    held = {r[:2]: r for r in sound}
    held["a", 130] = ("a", 130, 13, "damaged")
    del held["b", 0], held["b", 390]
    held["d", 5] = ("d", 5, 77, "extra archive")
    held["b", 1000] = ("b", 1000, 78, "extra record")
    assert audit(spark, sound, list(held.values())) == [
        ("a", 130, 13, "damaged"), ("b", 0, 0, "missing"), ("b", 390, 39, "missing"), ("b", 1000, 78, "extra"), ("d", 5, 77, "extra")]
    assert audit(spark, sound, sound[::-1]) == []


def test_nulls_repeats_and_empty_sides(spark, monkeypatch):
    monkeypatch.setattr(fixity, "PLACE_DIGITS", 4)  # a low tree
    rows = [(None, None, None, None), ("a", 0, 1, "x"), ("a", 0, 1, "x"), ("a", None, 2, "y"), ("a", 3, None, "")]
    assert audit(spark, rows, rows) == []
    assert audit(spark, rows, [rows[0], *rows[2:]]) == [("a", 0, 1, "damaged")]  # one copy less
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    assert {r.status for r in fixity.audit(some, none).collect()} == {"missing"} and fixity.audit(none, some).count() == 4
    assert fixity.audit(none, none).count() == 0


def test_only_mismatching_branches_are_followed(spark, monkeypatch):
    monkeypatch.setattr(fixity, "RANGE_BYTES", 10)
    monkeypatch.setattr(fixity, "FAN", 4)
    rows = spark.createDataFrame([("a", 10 * i, i, f"r{i}", 0) for i in range(64)], SCHEMA)
    levels = fixity.tree(fixity.leaves(rows), 3)
    assert [x.count() for x in levels] == [64, 16, 4, 1]
    other = rows.withColumn("record", F.when(F.col("id") == 21, "bad").otherwise(F.col("record")))
    changed = fixity.tree(fixity.leaves(other), 3)
    assert [fixity._differing(x, y, ["archive", "node"]).collect()[0].node for x, y in zip(levels, changed, strict=True)] == [21, 5, 1, 0]


def test_records_follow_one_another(spark):
    pages = spark.createDataFrame([(1, "http://a", "é"), (2, None, None), (1001, "http://b", "x"), (None, "http://c", "y")], "page_id long, url string, html string")
    made = fixity.page_records(pages)
    texts = {(r.archive[:14], r.id): r.record for r in made.collect()}
    got = {(r.archive[:14], r.id): r for r in fixity.laid_out(fixity.fingerprints(made)).collect()}
    first, second = got["pages-00000000", 1], got["pages-00000000", 2]
    assert (first.offset, second.offset) == (0, len(texts["pages-00000000", 1].encode())) and "Content-Length: 2\r\n" in texts["pages-00000000", 1]
    assert got["pages-00000001", 1001].offset == 0 and len(got) == 4


def follow_on(archive, ids, text=lambda i: f"record {i} " + "x" * (i % 13)):
    rows, at = [], 0
    for i in ids:
        rows.append((archive, at, i, text(i)))
        at += len(text(i))
    return rows


def test_records_that_moved_up_are_told_from_damaged_ones(spark, monkeypatch):
    monkeypatch.setattr(fixity, "RANGE_BYTES", 64)
    monkeypatch.setattr(fixity, "FAN", 4)
    sound = follow_on("a", range(200)) + follow_on("b", range(20))
    lost = follow_on("a", [i for i in range(200) if i != 5]) + follow_on("b", range(20))
    found = audit(spark, sound, lost)
    assert [r for r in found if r[3] != "moved"] == [("a", sound[5][1], 5, "missing")]
    assert [r[2] for r in found if r[3] == "moved"] == list(range(6, 200))
    # A shorter record in the place of one: it is damaged, all that follow have moved, and one comes in addition.
    harm = lambda i: "short" if i == 150 else f"record {i} " + "x" * (i % 13)
    other = follow_on("a", [*range(200), 900], harm) + follow_on("b", range(20))
    assert [r for r in audit(spark, sound, other) if r[3] != "moved"] == [("a", sound[150][1], 150, "damaged"), ("a", other[200][1], 900, "extra")]


def test_equal_records_are_paired_in_order_and_ids_may_be_null(spark, monkeypatch):
    monkeypatch.setattr(fixity, "RANGE_BYTES", 8)
    monkeypatch.setattr(fixity, "FAN", 2)
    sound = [("a", 10 * i, None, "same") for i in range(6)] + [("a", 60, None, "last")]
    assert audit(spark, sound, [("a", 10 * i, None, "same") for i in range(5)] + [("a", 50, None, "lost")]) == [
        ("a", 50, None, "damaged"), ("a", 60, None, "missing")]
    # One copy less, and the last one moved up: places 0 to 40 are sound.
    assert audit(spark, sound, [*sound[:5], ("a", 50, None, "last")]) == [("a", 50, None, "missing"), ("a", 60, None, "moved")]


def test_records_without_an_offset_spread_over_the_tree(spark, monkeypatch):
    monkeypatch.setattr(fixity, "PLACE_DIGITS", 6)
    rows = [("a", None, i, f"record {i}") for i in range(300)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    assert fixity.leaves(frame).where("place < 0").select("place").distinct().count() == 300
    changed = [*rows[:7], ("a", None, 7, "other"), *rows[8:299]]
    assert audit(spark, rows, changed) == [("a", -1, 7, "damaged"), ("a", -1, 299, "missing")]
    clash = frame.withColumn("length", F.lit("x")).withColumn("sha256", F.lit(0)).withColumn("place", F.lit(None))
    assert fixity.audit(clash, frame).count() == 0
