"""Files of known samples in every format, and broken ones."""

import io
import struct
import wave

import numpy as np
import pytest

from humsearch.sources.audio import read_audio
from humsearch.sources.audio_formats import ALAW, GUID, MULAW, AudioError, companded, read_uncompressed

X = np.array([0.0, 0.5, -0.5, 0.25, -1.0, 0.75])


def riff(form, data, order="<", more=b"", name=b"WAVE"):
    parts = more + b"fmt " + struct.pack(f"{order}I", len(form)) + form + b"data" + struct.pack(f"{order}I", len(data)) + data
    return (b"RIFF" if order == "<" else b"RIFX") + struct.pack(f"{order}I", len(parts) + 4) + name + parts


def form(kind, channels, bits, sr=8000, order="<"):
    return struct.pack(f"{order}HHIIHH", kind, channels, sr, 0, 0, bits)


def aiff(channels, bits, data, coding=None, skip=0):
    common = struct.pack(">hIh", channels, 0, bits) + struct.pack(">HQ", 16383 + 12, 8000 << (63 - 12)) + (coding + b"\0\0" if coding else b"")
    sound = struct.pack(">II", skip, 0) + b"z" * skip + data
    parts = b"COMM" + struct.pack(">I", len(common)) + common + b"odd " + struct.pack(">I", 3) + b"abc\0" + b"SSND" + struct.pack(">I", len(sound)) + sound
    return b"FORM" + struct.pack(">I", len(parts) + 4) + (b"AIFC" if coding else b"AIFF") + parts


def ints(bits, order, x=X):
    v = np.clip(np.rint(x * 2 ** (bits - 1)), -(2 ** (bits - 1)), 2 ** (bits - 1) - 1).astype(np.int64)
    return b"".join(int(a).to_bytes(bits // 8, "little" if order == "<" else "big", signed=True) for a in v)


GOOD = {
    "8 bits": riff(form(1, 1, 8), bytes((X * 128 + 128).clip(0, 255).astype(np.uint8))),
    **{f"{b} bits": riff(form(1, 1, b), ints(b, "<")) for b in (16, 24, 32)},
    **{f"{b} bits, big": riff(form(1, 1, b, order=">"), ints(b, ">"), ">") for b in (16, 24, 32)},
    "float": riff(form(3, 1, 32), X.astype("<f4").tobytes()),
    "double": riff(form(3, 1, 64), X.astype("<f8").tobytes(), more=b"LIST" + struct.pack("<I", 3) + b"abc\0"),
    "stereo": riff(form(1, 2, 16), ints(16, "<", np.repeat(X, 2) + np.tile([0.125, -0.125], 6) * (np.abs(np.repeat(X, 2)) < 0.6))),
    "extensible": riff(form(0xFFFE, 1, 32) + struct.pack("<HHIH", 22, 32, 4, 3) + GUID, X.astype("<f4").tobytes()),
    "cut short": riff(form(1, 1, 16), ints(16, "<"))[:-1] + b"",
    **{f"aiff {b}": aiff(1, b, ints(b, ">"), skip=4) for b in (8, 16, 24, 32)},
    "aifc little": aiff(1, 16, ints(16, "<"), b"sowt"),
    "aifc float": aiff(1, 32, X.astype(">f4").tobytes(), b"fl32"),
}


@pytest.mark.parametrize("name", GOOD)
def test_known_samples(name):
    x, sr = read_uncompressed(GOOD[name])
    want = X[:5] if name == "cut short" else X
    assert sr == 8000 and np.abs(x - want).max() <= (1 / 128 if "8" in name.split()[0] or name == "aiff 8" else 1e-4)


def test_as_the_standard_library():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(44100)
        w.writeframes(ints(16, "<", np.repeat(X, 2)))
    x, sr = read_uncompressed(out.getvalue())
    assert sr == 44100 and np.abs(x - X).max() < 1e-4


def test_companding():
    # known pairs of the two tables: the loudest, the quietest and the sign
    mu, a = companded(MULAW) * 32768, companded(ALAW) * 32768
    assert (mu[0x00], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0)
    assert (a[0x2A], a[0xAA], a[0xD5], a[0x55]) == (-32256, 32256, 8, -8)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256
    for kind, code in ((ALAW, 6), (MULAW, 7)):
        x, _ = read_uncompressed(riff(form(code, 1, 8), bytes(range(256))))
        assert x.tolist() == companded(kind).tolist()
    assert read_uncompressed(aiff(1, 8, bytes(range(256)), b"ulaw"))[0].tolist() == companded(MULAW).tolist()
    assert read_uncompressed(aiff(1, 8, bytes(range(256)), b"alaw"))[0].tolist() == companded(ALAW).tolist()


BAD = {
    b"": "not audio", b"RIFF0000AVI ": "not audio", riff(form(1, 1, 16), b"", name=b"WAVE")[:12]: "no format chunk",
    riff(form(1, 1, 16), b"")[:36]: "no data chunk", riff(b"short", b""): "bad format chunk", riff(form(1, 0, 16), b""): "bad format chunk",
    riff(form(2, 1, 16), b"xx"): "unknown encoding", riff(form(0xFFFE, 1, 16), b"xx"): "unknown encoding", riff(form(1, 1, 40), b"x" * 10): "unknown sample size",
    riff(form(3, 1, 16), b"xx"): "unknown sample size", aiff(1, 16, b"", b"QDMC"): "unknown encoding", aiff(0, 16, b""): "bad format chunk",
    b"FORM\0\0\0\4AIFF": "no format chunk",
}


@pytest.mark.parametrize("content", BAD)
def test_errors(content):
    with pytest.raises(AudioError) as e:
        read_uncompressed(content)
    assert e.value.kind == BAD[content]


def test_files(spark, tmp_path):
    long_ = np.tile(X, 2000)
    (tmp_path / "a.wav").write_bytes(riff(form(3, 1, 32), long_.astype("<f4").tobytes()))
    (tmp_path / "b.aif").write_bytes(aiff(1, 16, ints(16, ">", long_)))
    (tmp_path / "c.wav").write_bytes(riff(form(2, 1, 16), b"xx"))
    said = {r["path"][-5:]: r for r in read_audio(spark, str(tmp_path), errors=True).collect()}
    assert len(said["a.wav"]["samples"]) == len(said["b.aif"]["samples"]) == 12_000
    assert said["c.wav"]["error"] == "cannot be decoded: unknown encoding: 2"
