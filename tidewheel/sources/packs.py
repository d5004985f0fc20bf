"""Song packs: JSON documents of level arrays, read into frame rows and written from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel import constants as C
from tidewheel.constants import BLOCK
from tidewheel.functions.scalar import round_half_even
from tidewheel.operators.blocks import pack

LEVELS = ("bass", "lowmid", "mid", "high", "air", "rms", "rmsdb", "flux", "bflux", "hflux", "cent", "voc")
DECIMALS = {"rmsdb": 1}


def schema(tag: str = "format", levels: Sequence[str] = LEVELS) -> T.StructType:
    fields = [T.StructField(tag, T.StringType()), T.StructField("series_id", T.StringType()),
              T.StructField("fps", T.DoubleType()), T.StructField("dur", T.DoubleType()),
              T.StructField("first_frame", T.LongType()), T.StructField("bpm", T.DoubleType()),
              T.StructField("beat0", T.DoubleType()), T.StructField("period", T.DoubleType()),
              T.StructField("downbeat", T.DoubleType()), T.StructField("beats", T.ArrayType(T.DoubleType()))]
    fields += [T.StructField(k, T.ArrayType(T.DoubleType())) for k in levels]
    return T.StructType([*fields, T.StructField("_corrupt", T.StringType())])


def read_packs(spark: SparkSession, path: str, tag: str = "format", levels: Sequence[str] = LEVELS,
               multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, refused): the format tag is checked, not trusted.

    `multiline` reads one document per file; otherwise one per line. A document without a
    `series_id` takes its file's name.
    """
    docs = (spark.read.schema(schema(tag, levels)).option("multiLine", multiline)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
            .withColumn("source", F.col("_metadata.file_name")))
    docs = docs.withColumn("series_id", F.coalesce("series_id", F.regexp_replace("source", r"\.json$", "")))
    good = (F.col(tag) == C.PACK_FORMAT) & F.col("_corrupt").isNull()
    refused = docs.where(~F.coalesce(good, F.lit(False))).select(
        "source", F.lit("refuse").alias("level"), F.when(F.col("_corrupt").isNotNull(), "not JSON")
        .otherwise(F.concat(F.lit("format tag "), F.coalesce(tag, F.lit("missing")))).alias("message"))
    return docs.where(good).drop("_corrupt", "source"), refused


def pack_frames(docs: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Documents as frame rows: (series_id, frame, t, one column per level)."""
    rows = docs.select("series_id", F.coalesce("first_frame", F.lit(0)).alias("_f0"), F.coalesce("fps", F.lit(float(C.FPS))).alias("_fps"),
                       F.posexplode(F.arrays_zip(*[F.coalesce(F.col(k), F.array().cast("array<double>")).alias(k) for k in levels])).alias("_i", "_v"))
    return rows.select("series_id", (F.col("_f0") + F.col("_i")).alias("frame"),
                       ((F.col("_f0") + F.col("_i")) / F.col("_fps")).alias("t"), *[F.col(f"_v.{k}").alias(k) for k in levels])


def pack_documents(frames: DataFrame, levels: Sequence[str], tag: str = "format", fps: float = C.FPS,
                   size: int = BLOCK) -> DataFrame:
    """Frame rows as JSON documents, one per block of a series: rounded, and never a negative zero."""
    rounded = frames.select("series_id", "frame", *[round_half_even(F.col(k), DECIMALS.get(k, 3)).alias(k) for k in levels])
    blocks = pack(rounded, ["series_id"], "frame", levels, size)
    doc = F.to_json(F.struct(F.lit(C.PACK_FORMAT).alias(tag), F.col("series_id").cast("string").alias("series_id"),
                             F.lit(float(fps)).alias("fps"), F.col("frame")[0].alias("first_frame"), *levels))
    return blocks.select("series_id", doc.alias("value"))


def write_packs(frames: DataFrame, path: str, levels: Sequence[str], tag: str = "format", fps: float = C.FPS) -> None:
    """Write packs as JSON lines, spread over files by series block."""
    pack_documents(frames, levels, tag, fps).select("value").write.mode("overwrite").text(path)


def write_frames(frames: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    """The native sink: frame rows as Parquet, one dynamic overwrite per partition value."""
    writer = frames.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
