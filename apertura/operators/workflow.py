"""The work on a batch of images: randomizing and stripping metadata, each row's status, and the batch's summary.

A row that fails carries its error and no outputs; the others are not affected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apertura.functions import scalars as S
from apertura.functions.draws import SEED
from apertura.functions.exif_bytes import jpeg_size, read_tags, search_tags, strip_tags, write_tags
from apertura.functions.jpeg import encode_jpeg
from apertura.operators import generate as G
from apertura.operators.pixels import rendered
from apertura.operators.records import display_fields_of, display_from_tags, verified
from apertura.plans.render import render_plan


def original_day(tags: Column) -> Column:
    """The calendar day of a record of tags: of the first date text given, with months and days rolled over."""
    fields = display_fields_of(tags)
    return S.rolled_date(S.first_given(fields["DateTimeOriginal"], fields["DateTime"], tags["exif"]["DateTimeDigitized"]))


DONE = ("output", "fake", "output_name", "city", "parser", "warning", "message", "error", "is_synthetic")


def _written(df: DataFrame, content: str, names: list[str], keep_date: bool, as_of: str, seed: int) -> DataFrame:
    """The columns ``names`` with DONE: a synthetic record written into the JPEG bytes ``content`` and read back by two readers."""
    df = G.synthetic_records(df, "item_id", "__day" if keep_date else None, as_of, seed)
    df = df.withColumn("__size", jpeg_size(content))
    df = df.withColumn("__written", write_tags(content, G.tag_record(F.col("__size.width"), F.col("__size.height"))))
    df = df.withColumn("__read", read_tags("__written.content"))
    # The second reader counts only where the first finds nothing.
    df = df.withColumn("__found", search_tags(F.when(F.col("__read").isNull(), F.col("__written.content"))))
    place = {"GPSLatitude": F.col("place.lat"), "GPSLongitude": -F.abs(F.col("place.lon")), "GPSAltitude": F.col("altitude").cast("double")}
    shown = {f"__{k}": display_from_tags(F.col(f"__{v}"), dates=True, **place) for k, v in (("first", "read"), ("second", "found"))}
    df = verified(df.withColumns(shown), "__first", "__second", F.col("__written.error"))
    good, city = F.col("error").isNull() & F.col("__written.error").isNull(), F.col("loc.city")
    name = G.output_name(F.col("cam.make"), F.col("item_id"), as_of, seed)
    return df.select(
        *names,
        F.when(good, F.col("__written.content")).alias("output"),
        F.when(good, F.col("verified")).alias("fake"),
        F.when(good, name).alias("output_name"),
        F.when(good, city).alias("city"),
        F.when(good, F.col("parser")).alias("parser"),
        F.when(good, F.col("warning")).alias("warning"),
        F.when(good, F.coalesce("warning", done_text(name, city))).alias("message"),
        F.when(~good, F.coalesce("__written.error", "error")).alias("error"),
        "is_synthetic",
    )


def done_text(name: Column, city: Column) -> Column:
    """What is said of a finished item: its name and, if there is one, its city."""
    return F.concat(F.lit("Randomized "), name, F.coalesce(F.concat(F.lit(" | "), city), F.lit("")))


def randomized(items: DataFrame, keep_date: bool = False, as_of: str = G.AS_OF, seed: int = SEED) -> DataFrame:
    """Items (``item_id, content``) with their metadata replaced by a synthetic record; the picture data is not touched.

    Adds ``output`` (bytes), ``fake`` (the record as read back from them), ``output_name``, ``city``,
    ``parser`` (which reader read it back), ``warning`` (only the second could), ``message`` and ``error``.
    ``keep_date`` keeps the original's calendar day. Bytes that aren't a JPEG give an error and null outputs.
    """
    names = [c for c in items.columns if c not in DONE]
    df = items.select(*names)
    if keep_date:
        df = df.withColumn("__day", original_day(read_tags("content")).cast("timestamp"))
    return _written(df, "content", names, keep_date, as_of, seed)


def _encoded(df: DataFrame, seed: int) -> DataFrame:
    """``df`` with its ``image`` rendered under a ``plan`` and encoded as ``__jpeg``."""
    df = df.withColumns({"__width": F.col("image.width"), "__height": F.col("image.height")})
    df = rendered(render_plan(df, "item_id", "__width", "__height", seed), "item_id", seed=seed).drop("image")
    r = lambda name: F.col(f"rendered.{name}")
    return df.withColumn("__jpeg", encode_jpeg(r("data"), r("width"), r("height"), r("channels"), F.col("plan.quality"))).drop("rendered")


def reencoded(images: DataFrame, keep_date: bool = False, as_of: str = G.AS_OF, seed: int = SEED) -> DataFrame:
    """Decoded images (``item_id, image`` and, to keep the date, ``content``) from pixels to verified files.

    Each image is cropped, resized, turned and encoded under its plan, and then as in randomized(); the
    columns are those, with ``plan``. Images that can't be read give an error and null outputs.
    """
    names = [c for c in images.columns if c not in (*DONE, "plan", "image", "content")]
    df = images.select(*[c for c in images.columns if c not in (*DONE, "plan")])
    if keep_date:
        df = df.withColumn("__day", original_day(read_tags("content")).cast("timestamp"))
    df = _encoded(df.drop("content"), seed)
    return _written(df, "__jpeg", [*names, "plan"], keep_date, as_of, seed)


def stripped_items(items: DataFrame, as_of: str = G.AS_OF, seed: int = SEED) -> DataFrame:
    """Items with their metadata taken out: ``output``, ``output_name`` and ``error``; a failed row has no outputs at all."""
    done = items.drop("output", "output_name", "error", "fake").withColumn("__s", strip_tags("content"))
    name = G.output_name(F.lit(""), F.col("item_id"), as_of, seed)
    return done.select(
        *[c for c in done.columns if c != "__s"], F.col("__s.content").alias("output"), F.when(F.col("__s.error").isNull(), name).alias("output_name"), F.col("__s.error").alias("error")
    )


def stripped_images(images: DataFrame, as_of: str = G.AS_OF, seed: int = SEED) -> DataFrame:
    """As stripped_items(), for decoded images (``item_id, image``): encoded anew, so nothing but pixels is left."""
    names = [c for c in images.columns if c not in (*DONE, "plan", "image", "content")]
    done = _encoded(images.select(*names, "image"), seed)
    name = G.output_name(F.lit(""), F.col("item_id"), as_of, seed)
    good = F.col("__jpeg").isNotNull()
    return done.select(*names, "plan", F.col("__jpeg").alias("output"), F.when(good, name).alias("output_name"), F.when(~good, "the image can't be read").alias("error"))


def item_status(processing: Column, error: Column, has_output: Column, has_fake: Column) -> Column:
    """Processing, Error, Randomized, Stripped or Loaded, the first that holds."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(processing), "Processing")
        .when(F.coalesce(error, F.lit("")) != "", "Error")
        .when(yes(has_output) & yes(has_fake), "Randomized")
        .when(yes(has_output), "Stripped")
        .otherwise("Loaded")
    )


def latest_state(ops: DataFrame, key: str, order: list[str], state: list[str]) -> DataFrame:
    """The state after each key's last operation: a partial aggregate before one shuffle, no sort."""
    best = F.max_by(F.struct(*state), F.struct(*order)).alias("s")
    return ops.groupBy(key).agg(best).select(key, *[F.col(f"s.{c}").alias(c) for c in state])


def batch_summary(items: DataFrame, status: str = "status") -> DataFrame:
    """One row: how many items there are, are processed, failed or are at work, and the line that says so."""
    done = F.col(status).isin("Randomized", "Stripped")
    out = items.agg(
        F.count("*").alias("n_items"), F.count_if(done).alias("n_processed"), F.count_if(F.col(status) == "Error").alias("n_failed"),
        F.coalesce(F.bool_or(F.col(status) == "Processing"), F.lit(False)).alias("any_processing"),
    )
    line = F.concat(F.col("n_items").cast("string"), F.when(F.col("n_items") == 1, " image").otherwise(" images"), F.lit(" queued | "), F.col("n_processed").cast("string"), F.lit(" processed"))
    return out.withColumn("summary", line)
