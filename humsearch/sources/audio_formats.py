"""Samples of uncompressed audio files: RIFF (WAV) and AIFF, walked chunk by chunk."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np


class AudioError(ValueError):
    """A file that cannot be read; ``kind`` names what is wrong."""

    def __init__(self, kind: str, more: str = ""):
        super().__init__(f"{kind}{': ' if more else ''}{more}")
        self.kind = kind


# fixed values of the formats
PCM, FLOAT, ALAW, MULAW, EXTENSIBLE = 1, 3, 6, 7, 0xFFFE
#: The last 14 bytes of a subformat's GUID; the first two are the format.
GUID = bytes.fromhex("000000001000800000aa00389b71")


def chunks(content: bytes, order: str) -> Iterator[tuple[bytes, bytes]]:
    """(name, bytes) of the chunks of a form; each begins at an even place. The last one may be cut short by a broken recording."""
    at = 12
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from(f"{order}I", content, at + 4)[0]
        yield name, content[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def companded(kind: int) -> np.ndarray:
    """The sample that each byte of A-law or mu-law stands for, between -1 and 1."""
    b = np.arange(256)
    if kind == MULAW:
        v = ~b & 0xFF
        size = (((v & 0x0F) << 3) + 0x84 << ((v & 0x70) >> 4)) - 0x84
        return np.where(v & 0x80, -size, size) / 32768.0
    v = b ^ 0x55
    step, mantissa = (v & 0x70) >> 4, (v & 0x0F) << 4
    size = np.where(step == 0, mantissa + 8, mantissa + 0x108 << np.maximum(step - 1, 0))
    return np.where(v & 0x80, size, -size) / 32768.0


def _pcm(raw: bytes, bits: int, order: str, signed_bytes: bool) -> np.ndarray:
    width = -(-bits // 8)
    n = len(raw) // width
    if width == 1:
        return np.frombuffer(raw, np.int8, n) / 128.0 if signed_bytes else (np.frombuffer(raw, np.uint8, n) - 128.0) / 128.0
    if width == 3:
        b = np.frombuffer(raw, np.uint8, 3 * n).reshape(-1, 3).astype(np.int32)
        b = b if order == "<" else b[:, ::-1]
        return ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 2.0**23
    if width not in (2, 4):
        raise AudioError("unknown sample size", f"{bits} bits")
    return np.frombuffer(raw, f"{order}i{width}", n) / 2.0 ** (8 * width - 1)


def _float(raw: bytes, bits: int, order: str) -> np.ndarray:
    if bits not in (32, 64):
        raise AudioError("unknown sample size", f"float of {bits} bits")
    width = bits // 8
    return np.frombuffer(raw, f"{order}f{width}", len(raw) // width).astype(float)


def _mono(x: np.ndarray, channels: int) -> np.ndarray:
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(1)


def _wav(content: bytes, order: str) -> tuple[np.ndarray, int]:
    form = data = None
    for name, body in chunks(content, order):
        if name == b"fmt ":
            if len(body) < 16:
                raise AudioError("bad format chunk")
            form = body
        elif name == b"data" and data is None:
            data = body
    if form is None or data is None:
        raise AudioError("no format chunk" if form is None else "no data chunk")
    kind, channels, sr, _, _, bits = struct.unpack_from(f"{order}HHIIHH", form)
    if kind == EXTENSIBLE:
        if len(form) < 40 or form[26:40] != GUID:
            raise AudioError("unknown encoding", "extensible")
        kind = struct.unpack_from(f"{order}H", form, 24)[0]
    if not channels or not sr:
        raise AudioError("bad format chunk")
    if kind == PCM:
        x = _pcm(data, bits, order, False)
    elif kind == FLOAT:
        x = _float(data, bits, order)
    elif kind in (ALAW, MULAW):
        x = companded(kind)[np.frombuffer(data, np.uint8)]
    else:
        raise AudioError("unknown encoding", str(kind))
    return _mono(x, channels), sr


def _rate(extended: bytes) -> int:
    """A rate as an 80-bit number with 15 bits of exponent."""
    power, mantissa = struct.unpack(">HQ", extended)
    return round(mantissa * 2.0 ** ((power & 0x7FFF) - 16383 - 63))


def _aiff(content: bytes) -> tuple[np.ndarray, int]:
    common = sound = None
    for name, body in chunks(content, ">"):
        if name == b"COMM":
            common = body
        elif name == b"SSND" and sound is None:
            sound = body
    if common is None or sound is None or len(common) < 18 or len(sound) < 8:
        raise AudioError("bad format chunk" if common is not None and len(common) < 18 else "no format chunk" if common is None else "no data chunk")
    channels, _, bits = struct.unpack_from(">hIh", common)
    sr = _rate(common[8:18])
    coding = common[18:22] if content[8:12] == b"AIFC" else b"NONE"
    raw = sound[8 + struct.unpack_from(">I", sound)[0] :]
    if channels < 1 or sr < 1:
        raise AudioError("bad format chunk")
    if coding in (b"NONE", b"twos", b"in24", b"in32"):
        x = _pcm(raw, bits, ">", True)
    elif coding == b"sowt":
        x = _pcm(raw, bits, "<", True)
    elif coding in (b"fl32", b"FL32", b"fl64", b"FL64"):
        x = _float(raw, int(coding[2:]), ">")
    elif coding in (b"alaw", b"ALAW", b"ulaw", b"ULAW"):
        x = companded(ALAW if coding[:1] in b"aA" else MULAW)[np.frombuffer(raw, np.uint8)]
    else:
        raise AudioError("unknown encoding", coding.decode("latin-1"))
    return _mono(x, channels), sr


def read_uncompressed(content: bytes) -> tuple[np.ndarray, int]:
    """(mono samples within -1 and 1, rate) of a RIFF, RIFX, AIFF or AIFC file: PCM of
    8 to 32 bits, floats of 32 and 64, A-law and mu-law, also as extensible formats.
    Channels are averaged. Errors are AudioError: ``not audio``, ``no format chunk``,
    ``bad format chunk``, ``no data chunk``, ``unknown encoding``, ``unknown sample size``."""
    head, form = content[:4], content[8:12]
    if head in (b"RIFF", b"RIFX") and form == b"WAVE":
        return _wav(content, "<" if head == b"RIFF" else ">")
    if head == b"FORM" and form in (b"AIFF", b"AIFC"):
        return _aiff(content)
    raise AudioError("not audio")
