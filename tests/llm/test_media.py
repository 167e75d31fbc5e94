import numpy as np
import pytest

from glyphward.llm import jpeg, media


def pictures():
    rng = np.random.default_rng(0)
    return [rng.integers(0, 256, (int(h), int(w))).astype(np.uint8) for h, w in rng.integers(1, 70, (40, 2))]


def block_means(im):
    p = np.pad(im, ((0, -im.shape[0] % 8), (0, -im.shape[1] % 8)), mode="edge").astype(float)
    return p.reshape(p.shape[0] // 8, 8, -1, 8).mean((1, 3))


@pytest.mark.parametrize("restart", [0, 3])
def test_thumbnails_are_block_means(restart):
    ims = pictures()
    files = [jpeg.encode_gray(im, 4, restart) for im in ims]
    for im, (picture, thumb) in zip(ims, jpeg.luminance(files)):
        assert (picture.height, picture.width) == im.shape
        assert np.abs(thumb - block_means(im)).max() <= 1.01


def test_in_step_equals_one_at_a_time(monkeypatch):
    files = [media.render("text of a page " * k) for k in range(1, 60)]
    together = media.describe(files)
    monkeypatch.setattr(jpeg, "FEW", 10**9)
    assert media.describe(files) == together


def colour_file(blocks, h=2, v=2):
    """An interleaved picture of one MCU row whose DC values are given: (luminance blocks of an MCU, Cb, Cr) each."""
    (dv, dl), (av, al) = jpeg._codes(jpeg._DC), jpeg._codes(jpeg._AC)
    bits, pred = "", [0, 0, 0]
    for mcu in blocks:
        for c, values in enumerate(mcu):
            for x in values:
                d, pred[c] = x - pred[c], x
                s = abs(d).bit_length()
                bits += format(int(dv[s]), f"0{int(dl[s])}b") + (format(d if d > 0 else d + (1 << s) - 1, f"0{s}b") if s else "")
                bits += format(int(av[0]), f"0{int(al[0])}b")
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = lambda m, p: bytes([0xFF, m]) + (len(p) + 2).to_bytes(2, "big") + p
    frame = bytes([8]) + (8 * v).to_bytes(2, "big") + (8 * h * len(blocks)).to_bytes(2, "big") + bytes([3, 1, h << 4 | v, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xFE, b"note") + seg(0xDB, bytes([0]) + bytes([8]) * 64) + seg(0xC0, frame) + seg(0xC4, b"\0" + jpeg._DC) + seg(0xC4, b"\x10" + jpeg._AC) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"


def test_subsampled_colour():
    data = colour_file([([1, 2, 3, 4], [9], [-9]), ([5, 6, 7, 8], [0], [1])])
    for files in ([data], [data] * 40):
        picture, thumb = jpeg.luminance(files)[-1]
        assert len(picture.parts) == 3 and (thumb.astype(int) - 128).tolist() == [[1, 2, 5, 6], [3, 4, 7, 8]]


def test_edges(spark):
    good = jpeg.encode_gray(pictures()[0])
    progressive = good.replace(b"\xff\xc0", b"\xff\xc2", 1)
    rows = [(1, good), (1, good), (2, None), (3, b""), (4, b"GIF89a"), (5, good[: len(good) // 2]), (6, progressive), (None, good), (7, good[:40])]
    files = spark.createDataFrame([(k, bytearray(b) if b is not None else None, "x", 1) for k, b in rows], "page_id long, jpeg binary, status string, width int")
    got = {}
    for r in media.media_columns(files, "page_id", "jpeg").collect():
        got.setdefault(r["page_id"], []).append(r)
    status = {k: [r["status"] for r in v] for k, v in got.items()}
    assert status == {1: ["ok"] * 2, 2: [None], 3: ["corrupt"], 4: ["corrupt"], 5: ["corrupt"], 6: ["unsupported"], None: ["ok"], 7: ["corrupt"]}
    assert got[1][0] == got[1][1] and got[1][0]["thumb_hash"] == got[None][0]["thumb_hash"]
    assert media.media_columns(files.limit(0), "page_id", "jpeg").count() == 0
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 3_000_000)], "page_id long, html string")
    done = {r["page_id"]: r for r in media.media_columns(media.rendered_pages(texts), "page_id", "jpeg").collect()}
    assert done[1]["status"] is None and done[2]["status"] == "ok" and done[3]["width"] * done[3]["height"] >= 3_000_000


def test_hash_survives_scaling():
    ramp = np.add.outer(np.arange(160), np.arange(200)).astype(np.float64)
    im = (128 + 100 * np.sin(ramp / 25)).astype(np.uint8)
    a, b = (jpeg.luminance([jpeg.encode_gray(x)])[0][1] for x in (im, np.kron(im, np.ones((2, 2))).astype(np.uint8)))
    assert bin((media.dhash(a) ^ media.dhash(b)) & (2**64 - 1)).count("1") <= 6
