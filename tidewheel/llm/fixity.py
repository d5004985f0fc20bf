"""Fixity of WARC replicas: Merkle trees over offset ranges, compared from the roots down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators.blocks import number_rows
from tidewheel.session import settle

RANGE_BYTES = 1 << 16  # bytes of an archive under one lowest node
FAN = 16  # nodes under one node of the next level
PLACE_DIGITS = 10  # hexadecimal digits of a hash that give a record without an offset its place
CRLF = "\r\n"


def warc_record(record_id: Column, uri: Column, body: Column) -> Column:
    """A WARC response record as text: header, body, and the blank lines that end it."""
    body = F.coalesce(body, F.lit(""))
    fields = (("WARC-Type", F.lit("response")), ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">"))),
              ("WARC-Target-URI", F.coalesce(uri, F.lit(""))), ("Content-Type", F.lit("text/html; charset=utf-8")),
              ("Content-Length", F.octet_length(body).cast("string")))
    head = [part for name, value in fields for part in (F.lit(f"{name}: "), value, F.lit(CRLF))]
    return F.concat(F.lit("WARC/1.1" + CRLF), *head, F.lit(CRLF), body, F.lit(CRLF + CRLF))


def page_records(pages: DataFrame, per_archive: int = 1000, id_col: str = "page_id", uri_col: str = "url",
                 body_col: str = "html") -> DataFrame:
    """(archive, id, record): one archive for each range of `per_archive` ids.

    Pages without an id are archives of their own, named by their content's hash, so that no archive is
    larger than an id range unless ids repeat.
    """
    made = pages.select(F.col(id_col).cast("bigint").alias("id"), warc_record(F.col(id_col), F.col(uri_col), F.col(body_col)).alias("record"))
    return made.select(F.coalesce(F.format_string("pages-%08d.warc", F.floor(F.col("id") / per_archive)),
                                  F.concat(F.lit("unnamed-"), F.sha2("record", 256), F.lit(".warc"))).alias("archive"), "id", "record")


def fingerprints(records: DataFrame) -> DataFrame:
    """The records' other columns, their `length` in bytes and their `sha256`, taken where they are read: bodies go no further.

    A NULL record is an empty one. Columns named `length` or `sha256` are replaced.
    """
    body = F.coalesce(F.col("record").cast("binary"), F.lit(b""))
    kept = [c for c in records.columns if c.lower() not in ("record", "length", "sha256")]
    return records.select(*kept, F.octet_length(body).cast("bigint").alias("length"), F.sha2(body, 256).alias("sha256"))


def laid_out(prints: DataFrame) -> DataFrame:
    """(archive, offset, id, length, sha256): where each fingerprinted record stands when an archive's records follow
    one another by id, and by hash where ids repeat."""
    before = Window.partitionBy("archive").orderBy("id", "sha256").rowsBetween(Window.unboundedPreceding, -1)
    return prints.select("archive", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint").alias("offset"), "id", "length", "sha256")


def leaves(records: DataFrame) -> DataFrame:
    """(archive, place, id, length, digest): what stands at each place.

    A record's place is its offset. Repeated records are counted, and records that share a place are
    hashed together in order. A record without an offset (or with a negative one) has a place below zero that its hash
    gives, so that any number of them spreads over the tree. A NULL archive is ''.
    """
    prints = fingerprints(records) if "record" in records.columns else records
    offset = F.col("offset").cast("bigint")
    by_hash = -1 - F.conv(F.left("sha256", F.lit(PLACE_DIGITS)), 16, 10).cast("bigint")
    placed = prints.select(F.coalesce("archive", F.lit("")).alias("archive"), F.when(offset >= 0, offset).otherwise(by_hash).alias("place"),
                           F.col("id"), "length", F.col("sha256").alias("sha"))
    counted = placed.groupBy("archive", "place", "length", "sha").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    here = F.sort_array(F.collect_list(F.concat_ws(":", "length", "sha", "n")))
    one = F.when(F.count("*") == 1, F.when(F.max("n") == 1, F.max("sha")))
    return counted.groupBy("archive", "place").agg(
        F.min("id").alias("id"), F.sum(F.col("length") * F.col("n")).alias("length"),
        F.coalesce(one, F.sha2(F.concat_ws(",", here).cast("binary"), 256)).alias("digest"))


def _joined(position: str) -> Column:
    """The hash of all children's positions and digests, in order."""
    inside = F.sort_array(F.collect_list(F.struct(position, "digest")))
    return F.sha2(F.concat_ws(",", F.transform(inside, lambda x: F.concat_ws(":", x[position], x["digest"]))).cast("binary"), 256)


def tree(leaf_rows: DataFrame, levels: int) -> list[DataFrame]:
    """(archive, node, digest) of each level, from the lowest; node n of a level covers nodes FAN * n onward below."""
    node = F.floor(F.col("place") / RANGE_BYTES).alias("node")
    level = leaf_rows.groupBy("archive", node).agg(_joined("place").alias("digest"))
    out = [settle(level)]
    for _ in range(levels):
        level = out[-1].select("archive", F.floor(F.col("node") / FAN).alias("parent"), "node", "digest")
        level = level.groupBy("archive", "parent").agg(_joined("node").alias("digest")).withColumnRenamed("parent", "node")
        out.append(settle(level))
    return out


def _differing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose digests differ, or that one side lacks."""
    a, b = (side.select(*keys, F.col("digest").alias(name)) for side, name in ((left, "_left"), (right, "_right")))
    return a.join(b, keys, "full").where(~F.col("_left").eqNullSafe(F.col("_right"))).select(*keys)


def _singles(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The sides' rows joined on `keys`, which are unique on each side: (archive, left, right), either of them NULL."""
    row = F.struct("place", "id", "length", "digest")
    a, b = (side.select(*keys, row.alias(name)) for side, name in ((left, "left"), (right, "right")))
    return settle(a.join(b, keys, "full").select("archive", "left", "right"))


def _rest(pairs: DataFrame, side: str) -> DataFrame:
    """The rows of one side that have found no partner."""
    other = "right" if side == "left" else "left"
    return pairs.where(F.col(other).isNull()).select("archive", f"{side}.*")


def _paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of the same archive and key paired in the order of their places; those whose key is NULL stay alone."""
    sides = []
    for side, sign in ((left, -1), (right, 1)):
        block = F.floor(F.col("place") / (RANGE_BYTES * FAN))
        numbered = number_rows(side.where(F.col(key).isNotNull()).withColumn("_key", F.col(key)), ["archive", "_key"], ["place"], block, "_k")
        # A row without a key gets a number of its own, of different sign on either side.
        alone = side.where(F.col(key).isNull()).withColumn("_key", F.lit(None).cast(side.schema[key].dataType)).withColumn("_k", F.lit(sign).cast("bigint"))
        sides.append(numbered.select("archive", "place", "id", "length", "digest", "_key", "_k").unionByName(
            alone.select("archive", "place", "id", "length", "digest", "_key", "_k")))
    return _singles(*sides, ["archive", "_key", "_k"])


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Where two replicas differ: archive, offset, right_offset, id, status, and each side's length and SHA-256.

    Both have (archive, offset, id, record), or (archive, offset, id, length, sha256) of records fingerprinted before;
    each has the offsets of its own records. Each replica's tree is built on its own from record hashes.
    Archives whose roots agree are done; below a node that differs only its children are compared, down
    to the records. There a record that stands elsewhere in the same archive is `moved`: its content is sound. Of the others those
    of the same id, then those at the same offset are `damaged`; what is left over is `missing` (left has it, right doesn't) or
    `extra`. So a lost record counts as one, though all that follow have moved up. Trees
    follow offset ranges, so an archive may be of any size. Repeated records count; see leaves() for
    NULLs. `offset` is the left one where there is a left record; places without an offset are given as -1. Replicas without rows, and
    equal ones, give what follows from that. Other columns are ignored.
    """
    sides = [settle(leaves(side)) for side in (left, right)]
    furthest = max(side.agg(F.max(F.abs("place"))).first()[0] or 0 for side in sides)
    levels = 0
    while furthest // RANGE_BYTES // FAN**levels > 0:
        levels += 1
    trees = [tree(side, levels) for side in sides]
    # At the top every archive has its root, node 0, and node -1 for records without an offset.
    suspects = settle(_differing(trees[0][levels], trees[1][levels], ["archive", "node"]))
    for level in range(levels - 1, -1, -1):
        below = [t[level].join(suspects.withColumnRenamed("node", "_up"), (t[level]["archive"] == suspects["archive"])
                               & (F.floor(t[level]["node"] / FAN) == F.col("_up")), "left_semi") for t in trees]
        suspects = settle(_differing(*below, ["archive", "node"]))
    ranged = [side.withColumn("node", F.floor(F.col("place") / RANGE_BYTES)).join(suspects, ["archive", "node"], "left_semi") for side in sides]
    differing = _singles(*ranged, ["archive", "place", "digest"])
    moved = _paired(_rest(differing, "left"), _rest(differing, "right"), "digest")
    named = _paired(_rest(moved, "left"), _rest(moved, "right"), "id")
    placed = _singles(_rest(named, "left"), _rest(named, "right"), ["archive", "place"])
    both = F.col("left").isNotNull() & F.col("right").isNotNull()
    status = F.when(F.col("right").isNull(), "missing").when(F.col("left").isNull(), "extra").otherwise("damaged")
    found = moved.where(both).withColumn("status", F.lit("moved")).unionByName(
        named.where(both).withColumn("status", F.lit("damaged"))).unionByName(placed.withColumn("status", status))
    shown = lambda side: F.greatest(F.col(f"{side}.place"), F.when(F.col(side).isNotNull(), F.lit(-1).cast("bigint")))
    return found.select("archive", F.coalesce(shown("left"), shown("right")).alias("offset"), shown("right").alias("right_offset"),
                        F.coalesce("left.id", "right.id").alias("id"), "status", F.col("left.length").alias("left_length"),
                        F.col("right.length").alias("right_length"), F.col("left.digest").alias("left_sha256"), F.col("right.digest").alias("right_sha256"))
