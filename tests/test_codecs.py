import numpy as np
import pytest

from tickloom.sources import codecs
from tickloom.sources.codecs import Sound


def sounds():
    rng = np.random.default_rng(1)
    t = np.arange(9000)
    wave = np.stack([np.sin(t / 30) * 9000, np.cos(t / 17) * 3000 + rng.normal(0, 200, 9000)]).astype(np.int64)
    return [Sound(wave, 44_100), Sound(wave[:1, :1], 8000), Sound(np.zeros((1, 50), np.int64), 8000), Sound(rng.integers(-32768, 32768, (2, 5000)), 48_000), Sound(rng.integers(-128, 128, (3, 4098)), 8000, 8)]


def test_flac_is_lossless():
    for s in sounds():
        raw = codecs.encode_flac(s)
        got = codecs.decode_flac(raw)
        assert (got.samples == s.samples).all() and (got.rate, got.bits) == (s.rate, s.bits)
    assert len(codecs.encode_flac(sounds()[0])) < 0.7 * 4 * 9000
    for cut in (3, 20, 200):
        with pytest.raises((codecs.CodecError, IndexError)):
            codecs.decode_flac(codecs.encode_flac(sounds()[3])[:cut] if cut < 40 else codecs.encode_flac(sounds()[3])[:-cut])


def test_flac_subframes_by_hand():
    head = b"fLaC\x80\0\0\x22" + b"\0\x10\0\x10" + bytes(6) + (8000 << 44 | 1 << 41 | 15 << 36 | 16).to_bytes(8, "big") + bytes(16)
    text = f"{0xFFF8:016b}" + "0110" + "0000" + "1010" + "000" + "0" + "0" * 8 + f"{15:08b}" + "0" * 8  # middle and side, sixteen samples
    text += "0" + "000000" + "0" + f"{100:016b}"  # the middle: constant
    weights = [f"{1:05b}", f"{-1 & 31:05b}"]  # the side: order 2, x[n] = x[n-1] - x[n-2], residuals as they are
    text += "0" + "100001" + "0" + f"{3:017b}" + f"{1:017b}" + "0100" + "00000" + "".join(weights) + "00" + "0000" + "1111" + "00001" + "0" * 14
    text += "0" * (-len(text) % 8) + "0" * 16
    got = codecs.decode_flac(head + int(text, 2).to_bytes(len(text) // 8, "big")).samples
    side = [3, 1]
    for _ in range(14):
        side.append(side[-1] - side[-2])
    want = [((200 | s & 1) + s >> 1, (200 | s & 1) - s >> 1) for s in side]
    assert got.T.tolist() == [list(x) for x in want]


def test_qoa():
    assert codecs.QOA[0].tolist() == [1, -1, 3, -3, 5, -5, 7, -7] and codecs.QOA[1].tolist()[:4] == [5, -5, 18, -18] and codecs.QOA[15].tolist()[6:] == [14336, -14336]
    for s in sounds()[:3]:
        got = codecs.decode_qoa(codecs.encode_qoa(s))
        assert got.samples.shape == s.samples.shape and got.rate == s.rate
        assert np.abs(got.samples - s.samples)[:, 40:].max(initial=0) < 1000


def test_flash_adpcm():
    text = "10" + f"{1000 & 0xFFFF:016b}" + f"{10:06b}" + "0111" + "1111" + "0000"
    raw = int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")
    step, x, k = codecs.STEPS[10], 1000, 10
    want = [x]
    for code in (7, 15, 0):
        step = codecs.STEPS[k]
        change = (step >> 3) + sum(step >> b for b in range(3) if code & 4 >> b)
        x = x - change if code & 8 else x + change
        k = max(0, min(88, k + codecs.SWF_MOVES[4][code & 7]))
        want.append(x)
    assert codecs.decode_swf(raw)[0, :4].tolist() == want


@pytest.mark.parametrize("name", codecs.PICTURES)
def test_packed_pictures(name):
    rng = np.random.default_rng(2)
    top = 256 if name == "y41p" else 1024
    for w, h in ((8, 3), (48, 2), (56, 1)):
        sizes = {"v210": (w, (w + 1) // 2, (w + 1) // 2), "y41p": (w, w // 4, w // 4)}.get(name, (w, w, w))
        planes = [rng.integers(0, top, (h, k)) for k in sizes]
        decode, encode = codecs.PICTURES[name]
        assert all((a == b).all() for a, b in zip(decode(encode(planes), w, h), planes, strict=True))


def test_columns(spark):
    raw = codecs.encode_flac(sounds()[0])
    got = {r["k"]: r for r in codecs.decode_sounds(spark.createDataFrame([(1, raw), (2, raw[:-500]), (3, b"x"), (4, None)], "k int, content binary"), "flac").collect()}
    assert got[1]["samples"] == sounds()[0].samples.tolist() and got[2]["error"] and got[3]["error"] and got[4]["samples"] is None
