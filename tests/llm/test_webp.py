import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from astrolith.llm import webp


def picture(kind, h, w, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "noise":
        return rng.integers(0, 2**32, (h, w), dtype=np.uint32)
    if kind == "smooth":
        y, x = np.mgrid[:h, :w]
        c = np.stack([x * 3 + y, x + y * 5, x * y, 255 - x], axis=2) % 256
        return webp.words(c)
    colours = rng.integers(0, 2**32, int(kind), dtype=np.uint32)
    return colours[rng.integers(0, len(colours), (h, w))]


@pytest.mark.parametrize("kind", ["noise", "smooth", "1", "2", "4", "13", "200"])
@pytest.mark.parametrize("transforms", [(), (webp.GREEN,), (webp.PREDICTOR,), (webp.CROSS, webp.GREEN), (webp.PREDICTOR, webp.CROSS, webp.GREEN), (webp.PALETTE,), (webp.PALETTE, webp.PREDICTOR)])
def test_round_trip(kind, transforms):
    if webp.PALETTE in transforms and kind in ("noise", "smooth"):
        pytest.skip("too many colours")
    p = picture(kind, 9, 14)
    modes = np.array([0xFF000000 | m << 8 for m in range(14)], np.uint32)
    elements = np.random.default_rng(3).integers(0, 2**32, 12, dtype=np.uint32)
    for cache in (0, 4):
        data = webp.encode_image(p, transforms, cache, modes, elements)
        assert (webp.decode_image(data) == p).all()


def test_hand_made_stream():
    """A one-pixel image put together bit by bit: five simple codes of one symbol."""
    out = webp.Writer()
    for v, n in ((0x2F, 8), (0, 14), (0, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        out.put(v, n)
    for symbol in (10, 20, 30, 40, 0):
        for v, n in ((1, 1), (0, 1), (1, 1), (symbol, 8)):
            out.put(v, n)
    assert webp.decode_image(out.bytes()).tolist() == [[40 << 24 | 20 << 16 | 10 << 8 | 30]]


def test_prefix_values():
    for v in [*range(1, 300), 4096, 10**6]:
        s, extra, rest = webp.prefix_of(v)
        b = webp.Bits((rest).to_bytes(4, "little"))
        assert webp.read_value(b, s) == v and b.at == extra


def test_broken_data():
    good = webp.encode_image(picture("noise", 5, 5))
    for bad in (b"", b"\x2e" + good[1:], good[: len(good) // 2]):
        with pytest.raises(ValueError):
            webp.decode_image(bad)


def test_tiles_equal_the_general_decoder():
    preset, rnd = webp.Preset(), random.Random(2)
    bodies = [b"", b" ", b"a" * 191, b"a" * 192, b"x" * 40_000, bytes(range(256)) * 60, "Grüße, ñandú 日本\n".encode() * 900] + [bytes(rnd.choice(b"abc de\xc3\xa4") for _ in range(rnd.randrange(3000))) for _ in range(20)]
    for body in bodies:
        stored, size = webp.encode_text(body, preset)
        chunks = list(webp.files(stored))
        fast = b"".join(t.tobytes() for t in webp.decode_tiles(chunks, preset))
        slow = b"".join(p[..., :3].tobytes() for p in webp.decode(stored)) if len(body) < 20_000 else fast
        assert fast == slow == body.ljust(size, b" ") and size % 192 == 0


def test_store(spark):
    texts = [(1, "Grüße"), (2, None), (3, ""), (4, "a" * 30_000), (5, "Grüße"), (None, "b")]
    got = {r.doc_id: r for r in webp.store(spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, media long")).collect()}
    for i, t in texts:
        body = (t or "").encode()
        pad = body.ljust(max(1, -(-len(body) // 192)) * 192, b" ")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(body), len(pad), sha256(pad).hexdigest(), crc32(pad[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), sha256(r.media).hexdigest())
    assert got[1].feature == got[5].feature and got[1].media == got[5].media
    assert webp.store(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stored_texts_use_the_parts_of_the_format(monkeypatch):
    rnd = random.Random(5)
    prose = " ".join(rnd.choice(["river", "stone", "lamp", "ñandú", "orchard", "seven", "quiet", "bridge", "über", "a", "of"]) + rnd.choice(["", ",", "s"]) for _ in range(1500)).encode()
    grey = bytes(b for _ in range(2000) for b in [rnd.randrange(256)] * 3)
    lines = b"".join(bytes(rnd.randrange(33, 126) if rnd.random() < 0.3 else b for b in range(64, 127)) * 3 + b"..\n" for _ in range(40))
    bodies = [b"a short text", prose, grey, lines, prose[:900] * 3]
    seen = set()
    for name in ("undo_palette", "undo_green", "undo_cross", "undo_predictor"):

        def noted(*a, name=name, undo=getattr(webp, name)):
            if len(a) == 1 or name not in ("undo_green", "undo_cross") or a[-1] is not True:
                seen.add(name)
            return undo(*a)

        monkeypatch.setattr(webp, name, noted)
    preset, heads, caches = webp.Preset(), set(), set()
    for body in bodies:
        stored, size = webp.encode_text(body, preset)
        chunks = list(webp.files(stored))
        seen_before = set(seen)
        seen.clear()
        assert b"".join(t.tobytes() for t in webp.decode_tiles(chunks, preset)) == body.ljust(size, b" ")
        seen |= seen_before
        heads |= {c[5:40] for c in chunks}
    assert len(heads) >= len(bodies)  # each image has its own codes
    assert "undo_palette" in seen and len(seen) >= 2


def test_lockstep_equals_symbol_by_symbol():
    images = []
    for k, kind in enumerate(["noise", "smooth", "2", "13", "200"]):
        p = picture(kind, 5 + k, 20 - k, k)
        for transforms in [(), (webp.GREEN,), (webp.PREDICTOR, webp.CROSS)] + [(webp.PALETTE,)] * (k > 1):
            modes = np.array([0xFF000000 | m << 8 for m in range(14)], np.uint32)
            images += [(p, webp.encode_image(p, transforms, cache, modes, np.array([0xFF203040], np.uint32))) for cache in (0, 3, 11)]
    for (p, data), got in zip(images, webp.decode_images([d for _, d in images])):
        assert (got == p).all() and (webp.decode_image(data) == p).all()
    with pytest.raises(ValueError):
        webp.decode_images([images[0][1], images[1][1][:-40]])
