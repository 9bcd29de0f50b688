"""Pixels of decoded images (Spark's ``image`` source: rows of BGR bytes) under a render plan.

The crop, the fit into the export size, the small rotation and the 1 % enlargement are one affine map, which
is sampled bilinearly; noise of -1, 0 or 1 is added to each channel afterwards. functions/jpeg encodes the
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

ZOOM = 1.01
#: Rows of the output that are sampled at a time.
ROWS = 256
#: Bytes of pixels that are handed on together.
AT_ONCE = 1 << 24


def with_noise(pixels: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """-1, 0 and 1 with chances of 1, 2 and 1 in 4 on each of the first three channels; a fourth stays."""
    out = pixels.copy()
    noise = rng.integers(0, 2, out[..., :3].shape, dtype=np.int8) - rng.integers(0, 2, out[..., :3].shape, dtype=np.int8)
    out[..., :3] = np.clip(out[..., :3].astype(np.int16) + noise, 0, 255).astype(np.uint8)
    return out


def sampled(pixels: np.ndarray, plan: dict) -> np.ndarray:
    """The planned part of the image at the planned size and angle."""
    width, height = plan["out_width"], plan["out_height"]
    cos, sin = np.cos(np.radians(plan["angle"])), np.sin(np.radians(plan["angle"]))
    out = np.empty((height, width, pixels.shape[2]), np.uint8)
    x = np.arange(width) + 0.5 - width / 2
    planes = [np.ascontiguousarray(pixels[..., k]).ravel() for k in range(pixels.shape[2])]
    low_x, low_y = plan["crop_left"], plan["crop_top"]
    high_x, high_y = low_x + plan["src_width"] - 1, low_y + plan["src_height"] - 1
    for at in range(0, height, ROWS):
        y = (np.arange(at, min(height, at + ROWS)) + 0.5 - height / 2)[:, None]
        u = ((x * cos + y * sin) / ZOOM + width / 2) * plan["src_width"] / width - 0.5 + low_x
        v = ((y * cos - x * sin) / ZOOM + height / 2) * plan["src_height"] / height - 0.5 + low_y
        u, v = np.clip(u, low_x, high_x), np.clip(v, low_y, high_y)
        left, top = np.floor(u).astype(np.int64), np.floor(v).astype(np.int64)
        right, bottom = np.minimum(left + 1, high_x), np.minimum(top + 1, high_y)
        a, b = u - left, v - top
        corners = [y * pixels.shape[1] + x for y in (top, bottom) for x in (left, right)]
        for k, plane in enumerate(planes):
            one, two, three, four = (plane[at_corner] for at_corner in corners)
            upper = one * (1 - a) + two * a
            lower = three * (1 - a) + four * a
            out[at : at + ROWS, :, k] = np.floor(upper * (1 - b) + lower * b + 0.5).astype(np.uint8)
    return out


@arrow_udf(T.BinaryType())
def _render(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Of ``data, width, height, channels, plan, seed``."""
    for data, *others in columns:
        out, held = [], 0
        for raw, w, h, c, p, s in zip(data, *(x.to_pylist() for x in others), strict=True):
            raw = raw.as_buffer() if raw.is_valid else b""
            if not len(raw) or not p or not c or len(raw) != w * h * c:
                out.append(None)
                continue
            pixels = np.frombuffer(raw, np.uint8).reshape(h, w, c)
            done = pixels if p["bypass"] else with_noise(sampled(pixels, p), np.random.default_rng(s & (2**63 - 1)))
            out.append(done.tobytes())
            held += done.nbytes
            if held >= AT_ONCE:
                yield pa.array(out, pa.binary())
                out, held = [], 0
        if out:
            yield pa.array(out, pa.binary())


def rendered(df: DataFrame, key: str, image: str = "image", plan: str = "plan", seed: int = 42) -> DataFrame:
    """``df`` with ``rendered``: width, height, channels and bytes of each image under its plan; null bytes where it can't be read."""
    i, p = (lambda name: F.col(f"{image}.{name}")), F.col(plan)
    data = _render(i("data"), i("width"), i("height"), i("nChannels"), p, F.xxhash64(F.lit(seed), key))
    return df.withColumn("rendered", F.struct(p["out_width"].alias("width"), p["out_height"].alias("height"), i("nChannels").alias("channels"), data.alias("data")))
