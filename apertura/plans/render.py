"""The geometry of an export as columns: crop, size, angle and quality are drawn here, pixels are touched elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apertura.functions import scalars as S
from apertura.functions.draws import SEED, pick, rand_int, unit

#: An image with a shorter side after the crop is left as it is.
LEAST_SIDE = 100
SIDES = ("top", "bottom", "left", "right")


def jpeg_quality(key: Column, seed: int = SEED) -> Column:
    """From 0.80 to below 0.88."""
    return F.lit(0.80) + unit(key, "quality", seed) * 0.08


def render_plan(df: DataFrame, key: str, width: str, height: str, seed: int = SEED) -> DataFrame:
    """``df`` with the struct ``plan``: bypass, crop offsets and size, max_edge, out_width, out_height, angle (degrees), quality.

    Small images are bypassed: neither cropped nor resized nor turned; their quality is drawn all the same.
    """
    k = F.col(key)
    crop = {side: rand_int(k, f"crop_{side}", 1, 6, seed) for side in SIDES}
    src_w = F.col(width) - crop["left"] - crop["right"]
    src_h = F.col(height) - crop["top"] - crop["bottom"]
    df = df.withColumns({"__w": src_w.cast("int"), "__h": src_h.cast("int"), "__edge": pick(k, "max_edge", S.MAX_EDGES, seed)})
    bypass = (F.col("__w") < LEAST_SIDE) | (F.col("__h") < LEAST_SIDE)
    size = S.export_size(F.col("__w"), F.col("__h"), F.col("__edge"))
    used = lambda c, otherwise: F.when(bypass, otherwise).otherwise(c)
    plan = F.struct(
        bypass.alias("bypass"),
        used(crop["left"], 0).alias("crop_left"),
        used(crop["top"], 0).alias("crop_top"),
        used(F.col("__w"), F.col(width)).cast("int").alias("src_width"),
        used(F.col("__h"), F.col(height)).cast("int").alias("src_height"),
        used(F.col("__edge"), F.lit(None).cast("int")).alias("max_edge"),
        used(size["width"], F.col(width)).cast("int").alias("out_width"),
        used(size["height"], F.col(height)).cast("int").alias("out_height"),
        used((unit(k, "angle", seed) - 0.5) * 0.6, F.lit(0.0)).alias("angle"),
        jpeg_quality(k, seed).alias("quality"),
    )
    return df.withColumn("plan", plan).drop("__w", "__h", "__edge")
