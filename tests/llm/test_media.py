"""Progressive JPEG: exact round trips of coefficients, and samples against Java's decoder."""

import hashlib
import zlib

import numpy as np
import pytest

from hitgrid.llm import jpeg, media

LAYOUTS = [(16, 16, [(2, 2), (1, 1), (1, 1)]), (33, 17, [(2, 2), (1, 1), (1, 1)]), (40, 24, [(1, 1)] * 3), (50, 70, [(1, 1)]), (100, 31, [(2, 1), (1, 1), (1, 1)])]


def made(w, h, shapes, dense, restart, seed=0):
    rng = np.random.default_rng(seed)
    across, down = -(-w // (8 * max(s[0] for s in shapes))), -(-h // (8 * max(s[1] for s in shapes)))
    parts = []
    for x, y in shapes:
        n = across * x * down * y
        c = rng.choice([-1, 1], (n, 64)) * rng.integers(128, 256, (n, 64)) if dense else rng.integers(-40, 41, (n, 64)) * (rng.random((n, 64)) < 0.2)
        parts.append((x, y, c))
    return jpeg.encode(w, h, parts, restart=restart), parts


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("dense", [False, True])
@pytest.mark.parametrize("restart", [1, 3, 8])
def test_coefficients_round_trip(layout, dense, restart):
    files = [made(*layout, dense, restart, k) for k in range(3)]
    images, found = jpeg.decode_coefficients([f for f, _ in files])
    for image, (_, parts) in zip(images, files, strict=True):
        for c, (_, _, want) in zip(image.components, parts, strict=True):
            y, x = np.mgrid[0 : c.used_high, 0 : c.used_wide]
            own = (y * c.wide + x).ravel()
            assert (found[c.base + own] == want[own]).all()


@pytest.mark.parametrize("layout", [x for x in LAYOUTS if len(x[2]) == 1 or x[2][0] == (1, 1)])
def test_samples_match_java(spark, layout):
    data, _ = made(*layout, False, 8)
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    images, found = jpeg.decode_coefficients([data])
    got = jpeg.samples(images[0], found).astype(int)
    gray, raster = image.getRaster().getNumBands() == 1, image.getRaster()  # getRGB would apply a gamma to gray samples

    def pixel(x, y):
        rgb = raster.getSample(x, y, 0) * 0x10101 if gray else image.getRGB(x, y)
        return [(rgb >> 16) & 255, (rgb >> 8) & 255, rgb & 255]

    want = np.array([[pixel(x, y) for x in range(image.getWidth())] for y in range(image.getHeight())])
    assert got.shape == want.shape and np.abs(got - want).max() <= 3


def test_java_files_decode(spark):
    """A progressive file by another writer, without restarts and with its own tables."""
    jvm = spark._jvm
    source = jvm.java.awt.image.BufferedImage(61, 45, 1)
    for x in range(61):
        for y in range(45):
            source.setRGB(x, y, (x * 4 % 256) << 16 | (y * 5 % 256) << 8 | (x * y % 256))
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    params = writer.getDefaultWriteParam()
    params.setProgressiveMode(1)  # MODE_DEFAULT
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(source, None, None), params)
    writer.dispose()
    data = bytes(out.toByteArray())
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    images, found = jpeg.decode_coefficients([data, data])
    got = jpeg.samples(images[1], found).astype(int)
    want = np.array([[[(rgb >> 16) & 255, (rgb >> 8) & 255, rgb & 255] for rgb in [image.getRGB(x, y) for x in range(61)]] for y in range(45)])
    assert images[0].progressive and np.abs(got - want).mean() < 12  # chroma is repeated here, Java smooths it


def test_payloads(spark):
    texts = ["", None, "a", "é" * 100, "x" * 64, "y" * 65, "same", "same", "long " * 9000]
    table = spark.createDataFrame([(k, t, "m") for k, t in enumerate(texts)], "doc_id long, text string, media string")
    stored = media.store_payloads(table)
    rows = {r.doc_id: r for r in media.read_payloads(stored).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert rows[6].media_sha256 == rows[7].media_sha256 and rows[6].feature == rows[7].feature
    tensors = {r.doc_id: r for r in media.decode_media(stored).collect()}
    assert all(len(t.rgb) == 3 * t.height * t.width for t in tensors.values())
    assert media.read_payloads(media.store_payloads(table.limit(0))).count() == 0


def test_broken_files_have_a_reason_and_do_not_touch_others(spark):
    """Null, empty, cut off and foreign bytes beside sound files, in any order."""
    good = [made(*LAYOUTS[k], False, 3, k)[0] for k in range(3)]
    files = [good[0], None, b"", good[1][: len(good[1]) // 2], b"no picture", good[1], good[2][:3], bytes(200), good[2], b"\xff\xd8\xff\xd9"]
    rows = spark.createDataFrame([(k % 4 or None, f, 7) for k, f in enumerate(files)], "doc_id int, media binary, n_bytes long").coalesce(1)
    got = media.decode_media(rows).collect()
    assert len(got) == len(files)
    alone = {bytes(f): media.decode_media(spark.createDataFrame([(1, f)], "doc_id int, media binary")).first().rgb for f in good}
    for r, f in zip(got, files, strict=True):
        sound = f is not None and bytes(f) in alone
        assert (r.rgb is not None) == (r.reason is None) == (r.height is not None) and (not sound or r.rgb == alone[bytes(f)])
    assert [r.reason is None for r in got if r.doc_id == 1] == [False, True, False] and got[1].reason == "null"
    back = media.read_payloads(media.store_payloads(spark.createDataFrame([(1, "text")], "doc_id int, text string")).unionByName(rows.select("doc_id", "n_bytes", "media"))).collect()
    assert len(back) == len(files) + 1 and [r.feature is None for r in back[1:]] == [r.reason is not None for r in got]
    assert all((r.media_bytes is None) == (f is None) for r, f in zip(back[1:], files, strict=True))
