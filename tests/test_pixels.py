"""Encoder in bands and decoder, against the JVM's own reader and writer."""

import base64
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import pytest

from apertura.functions import jpeg as J
from apertura.functions import jpeg_read as R
from apertura.operators import pixels as P
from apertura.plans import catalogue
from apertura.sources import images


def picture(height: int, width: int) -> np.ndarray:
    y, x = np.mgrid[0:height, 0:width]
    return np.stack([np.sin(x / 20) * 60 + 128, np.cos(y / 30) * 80 + 128, (x + y) / 3], axis=-1).clip(0, 255).astype(np.uint8)


def jvm_written(spark, pixels: np.ndarray, path: Path, progressive: bool) -> bytes:
    """The pixels as the JVM's writer encodes them (halved chrominance, in several scans if progressive)."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(pixels.shape[1], pixels.shape[0], 5 if pixels.shape[2] == 3 else 10)
    image.getRaster().setDataElements(0, 0, pixels.shape[1], pixels.shape[0], jvm.java.util.Base64.getDecoder().decode(base64.b64encode(pixels[..., ::-1].tobytes()).decode()))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)
    param.setCompressionQuality(0.95)
    if progressive:
        param.setProgressiveMode(1)
    out = jvm.javax.imageio.ImageIO.createImageOutputStream(jvm.java.io.File(str(path)))
    writer.setOutput(out)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    out.close()
    return path.read_bytes()


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("channels", [1, 3])
def test_decoder_reads_what_the_jvm_writes(spark, tmp_path, progressive, channels):
    for k, size in enumerate([(61, 83), (8, 8), (1, 1), (33, 130)]):
        pixels = picture(*size)[..., :channels]
        data = jvm_written(spark, pixels, tmp_path / f"{k}.jpg", progressive)
        assert (b"\xff\xc2" in data) == progressive
        got = R.decoded(data)
        assert got.shape == pixels.shape and np.abs(got.astype(int) - pixels).mean() < 3
    theirs = {r["image"]["origin"].split("/")[-1]: r["image"] for r in images.load_pixels(spark, str(tmp_path)).collect()}
    for name, i in theirs.items():
        want = np.frombuffer(i["data"], np.uint8).reshape(i["height"], i["width"], i["nChannels"]).astype(int)
        assert np.abs(R.decoded((tmp_path / name).read_bytes()) - want).mean() < 2


@pytest.mark.parametrize("halved", [False, True])
def test_bands_are_read_by_both(spark, tmp_path, monkeypatch, halved):
    """Many bands (restart markers count round), odd sizes, grey and colour."""
    monkeypatch.setattr(J, "BAND", 20)
    pictures = {"colour": picture(301, 83), "grey": picture(150, 41)[..., :1], "one": picture(1, 1)}
    for name, pixels in pictures.items():
        (tmp_path / f"{name}.jpg").write_bytes(J.encoded(pixels, 0.95, halved))
    theirs = {r["image"]["origin"].split("/")[-1][:-4]: r["image"] for r in images.load_pixels(spark, str(tmp_path)).collect()}
    assert set(theirs) == set(pictures)
    for name, pixels in pictures.items():
        i, own = theirs[name], R.decoded((tmp_path / f"{name}.jpg").read_bytes())
        jvm = np.frombuffer(i["data"], np.uint8).reshape(own.shape)
        assert own.shape == pixels.shape
        assert all(np.abs(x.astype(int) - pixels).mean() < 3 for x in (own, jvm))


def test_the_band_size_does_not_change_the_pixels(monkeypatch):
    pixels = picture(120, 90)
    whole = R.decoded(J.encoded(pixels, 0.8, True))
    monkeypatch.setattr(J, "BAND", 1)
    assert (R.decoded(J.encoded(pixels, 0.8, True)) == whole).all()


def test_a_large_noisy_picture_takes_bounded_memory():
    code = (
        "import resource, numpy as np; from apertura.functions import jpeg as J; p = np.random.default_rng(0).integers(0, 256, (2400, 3200, 3), dtype=np.uint8);"
        "base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; J.encoded(p, 0.88); print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=120, check=True)
    assert int(done.stdout) < 300


def test_broken_bytes_are_null(spark):
    """Cut off anywhere, spoiled, empty, null, or of a size that the bytes can't fill."""
    data = J.encoded(picture(40, 40), 0.9)
    at = data.index(b"\xff\xc0")
    vast = data[: at + 5] + b"\xff\xff\xff\xff" + data[at + 9 :]
    cut = [data[:n] for n in range(0, len(data) - 2, 37)]
    rng = np.random.default_rng(1)
    spoiled = [bytes(b if rng.random() > 0.02 else int(rng.integers(256)) for b in data) for _ in range(60)]
    rows = [(x,) for x in [None, b"", b"junk", vast, *cut, *spoiled, data]]
    got = [r[0] for r in spark.createDataFrame(rows, "content binary").select(R.decode_jpeg("content")).collect()]
    assert got[: 4 + len(cut)] == [None] * (4 + len(cut)) and got[-1]["width"] == 40
    pair = spark.createDataFrame([(b"\x01\xff", b"\x03\xf0"), (b"", b""), (None, b"a"), (b"ab", b"a")], "a binary, b binary")
    assert [r[0] for r in pair.select(R.largest_difference("a", "b")).collect()] == [15, None, None, None]


def test_pictures_are_spread_and_tables_of_codes_are_quick(spark, tables):
    """A small table is one partition, but its pictures are many tasks; a table of codes isn't made entry by entry."""
    for query in (catalogue.decoded_pixels, catalogue.reencoded_images):
        assert query(spark, tables[1]).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    began = time.process_time()
    for _ in range(100):
        table = R.lookup(bytes([0, 1, 5] + [0] * 13), bytes(range(6)))
    assert time.process_time() - began < 0.15
    assert [table[k << 13] for k in range(8)] == [2 * 256] * 2 + [3 * 256 + k for k in range(1, 6)] + [0]
    with pytest.raises(R.Broken):
        R.lookup(bytes([3] + [0] * 15), bytes(3))


def test_pixels_are_handed_on_in_small_batches():
    """However many small files come at once."""
    import pyarrow as pa

    files = [J.encoded(picture(300, 300), 0.8)] * 80 + [None, b"junk"]
    got = list(R.decode_jpeg.func(iter([pa.array(files, pa.binary())])))
    assert [x for part in got for x in part.is_valid().to_pylist()] == [True] * 80 + [False] * 2
    assert len(got) == 2 and max(part.nbytes for part in got) < R.AT_ONCE + 2 * 300 * 300 * 3
    plan = {"bypass": True}
    columns = [pa.array([bytes(300 * 300 * 3)] * 80 + [None]), *(pa.array([n] * 81) for n in (300, 300, 3, plan, 1))]
    assert [len(part) for part in P._render.func(iter([columns]))] == [63, 18]
