"""Random draws that depend on a seed, a row's key and the name of the draw, and on nothing else.

``rand()`` changes with the partitioning; these don't, need no shuffle and can be recomputed after a lost
task. Draws of different names are independent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
#: Draws that take their 32 bits from one digest; a name that stands in none has a digest of its own.
GROUPS = (
    ("camera", "location", "lens", "sub_sec"),
    ("shutter", "aperture", "iso", "focal"),
    ("date", "hour", "minute", "second"),
    ("flash", "metering", "program", "white_balance"),
    ("lat", "lon", "altitude", "dpi"),
    ("seq", "name_hour", "name_minute", "name_second"),
    ("crop_top", "crop_bottom", "crop_left", "crop_right"),
    ("max_edge", "angle", "quality"),
)
PLACES = {name: (group[0], 8 * k + 1) for group in GROUPS for k, name in enumerate(group)}


def draw(key: Column, name: str, seed: int = SEED) -> Column:
    """A whole number from 0 to 2**32 - 1."""
    group, at = PLACES.get(name, (name, 1))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(group)))
    return F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")


def unit(key: Column, name: str, seed: int = SEED) -> Column:
    """From 0 to below 1."""
    return draw(key, name, seed) / F.lit(4294967296.0)


def rand_int(key: Column, name: str, low: int, high: int, seed: int = SEED) -> Column:
    """A whole number from ``low`` to ``high``, both included."""
    return (F.lit(low) + draw(key, name, seed) % (high - low + 1)).cast("int")


def pick(key: Column, name: str, options: Column | Sequence, seed: int = SEED) -> Column:
    """An element of an array column or of a list; repeat an element to make it likelier. Null for an empty array."""
    array = options if isinstance(options, Column) else F.array(*map(F.lit, options))
    return F.when(F.size(array) > 0, F.get(array, (draw(key, name, seed) % F.size(array)).cast("int")))
