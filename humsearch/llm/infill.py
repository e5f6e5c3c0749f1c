"""Fill-in-middle transformation over succinct token boundaries.

A text's tokens are runs of white space with the word that follows, or white space
alone at the end. Where tokens begin is a bitvector over the bytes of the texts at
hand, packed eight to a byte, with a directory of popcounts before each block: the
number of tokens of a text is the popcount of its bits, and the byte at which its
k-th token begins is a select. Another such vector of first bytes of characters
turns bytes into code points by rank. No token is ever made a string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Bits between two entries of the directory.
BLOCK = 512
#: Bytes of text that are looked at together, unless one text has more.
PIECE_BYTES = 8_000_000
# fixed values: what separates words, and the marks of a rearranged text
SPACES = b" \t\n\v\f\r"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_BYTES = BLOCK // 8
#: Of each byte, the place of its k-th set bit, highest bit first (8 where there is none).
_PLACES = np.array([([k for k in range(8) if byte >> (7 - k) & 1] + [8] * 8)[:8] for byte in range(256)], np.uint8)
_IS_SPACE = np.isin(np.arange(256), list(SPACES))


class BitVector:
    """Packed bits with rank and select of many places at once."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits)
        self.words = np.zeros((self.n // BLOCK + 1, _BYTES), np.uint8)
        self.words.ravel()[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words).sum(1, dtype=np.int64), out=self.before[1:])

    def __len__(self) -> int:
        return self.n

    @property
    def total(self) -> int:
        return int(self.before[-1])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Set bits before each place (0 to n)."""
        block, rest = np.divmod(places, BLOCK)
        byte, bit = np.divmod(rest, 8)
        counts = np.bitwise_count(self.words[block])
        whole = np.where(np.arange(_BYTES)[None, :] < byte[:, None], counts, 0).sum(1, dtype=np.int64)
        part = np.bitwise_count(self.words[block, byte] >> (8 - bit).astype(np.uint8))
        return self.before[block] + whole + np.where(bit > 0, part, 0)

    def select(self, ks: np.ndarray) -> np.ndarray:
        """Place of the k-th set bit (from 0) for each k; n for k = total."""
        if not len(ks):
            return np.zeros(0, np.int64)
        if ks.min() < 0 or ks.max() > self.total:
            raise IndexError("no such bit")
        there = np.minimum(ks, max(0, self.total - 1))
        block = np.searchsorted(self.before, there, side="right") - 1
        block = np.minimum(block, len(self.words) - 1)
        rest = there - self.before[block]
        sums = np.cumsum(np.bitwise_count(self.words[block]), axis=1, dtype=np.int64)
        byte = (sums > rest[:, None]).argmax(1)
        inside = rest - np.where(byte > 0, sums[np.arange(len(ks)), byte - 1], 0)
        place = block * BLOCK + byte * 8 + _PLACES[self.words[block, byte], np.clip(inside, 0, 7)]
        return np.where(ks < self.total, place, self.n)


def boundaries(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> BitVector:
    """Bits at the bytes where tokens begin, of texts that lie at ``starts`` to ``ends`` of ``data``."""
    space = _IS_SPACE[data]
    bits = np.zeros(len(data), bool)
    bits[1:] = space[1:] & ~space[:-1]
    bits[starts[ends > starts]] = True
    return BitVector(bits)


def _pieces(texts: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """(from, texts) so that a piece has a bounded number of bytes, or one text."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


def _rearranged(texts: pa.Array, draws: np.ndarray, rate: int, suffix_first: int) -> list[pa.Array]:
    """Columns n, form, prefix_chars, middle_chars, output of texts and their four random numbers."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    tokens, letters = boundaries(data, starts, ends), BitVector((data & 0xC0) != 0x80)
    first, last = tokens.rank(starts), tokens.rank(ends)
    n = last - first
    two = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    marked = np.asarray(pc.fill_null(pc.match_substring_regex(texts, "<[PSM]>"), False))
    plain = (n == 0) | marked | (draws[:, 2] % 100 >= rate)
    spm = draws[:, 3] % 100 < suffix_first
    # a cut after all tokens is the text's end; the next text's first token begins there or beyond
    cut, to = (np.where(two[:, k] < n, tokens.select(first + np.minimum(two[:, k], n)), ends) for k in (0, 1))
    chars = letters.rank(np.concatenate([starts, cut, to])).reshape(3, -1)
    forms = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    out = []
    view = memoryview(data)
    for kind, a, b, c, d in zip(forms.tolist(), starts.tolist(), cut.tolist(), to.tolist(), ends.tolist(), strict=True):
        if kind == "plain":
            out.append(bytes(view[a:d]))
        elif kind == "psm":
            out.append(b"".join([b"<P>", view[a:b], b"<S>", view[c:d], b"<M>", view[b:c]]))
        else:
            out.append(b"".join([b"<S>", view[c:d], b"<P>", view[a:b], b"<M>", view[b:c]]))
    return [pa.array(n, pa.int64()), pa.array(forms), pa.array(chars[1] - chars[0], pa.int64(), mask=plain), pa.array(chars[2] - chars[1], pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())]


def infill(docs: DataFrame, seed: int = 42, rate: int = 50, suffix_first: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each text of ``docs``
    (doc_id, text), cut into prefix, middle and suffix and put together anew.

    ``n`` is the number of tokens. Of the first four 8-digit groups h1 to h4 of the
    hex SHA-256 of ``seed:doc_id``, the prefix ends after the smaller of h1 and h2,
    modulo n + 1 each, and the middle after the larger; h3 % 100 under ``rate`` says
    whether the text is rearranged, h4 % 100 under ``suffix_first`` that the suffix
    leads. ``form`` is ``psm``, ``spm`` or ``plain``; texts that are empty or hold a
    mark stay plain, so that ``restored`` is exact. Null texts are empty, and a null
    doc_id is the empty word after the seed. Rows with the same doc_id and text give the
    same result. Other columns play no part; an empty table gives no rows.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *draw)
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = np.stack([np.asarray(batch.column(2 + k)) for k in range(4)], 1) if batch.num_rows else np.zeros((0, 4), np.int64)
            for at, texts in _pieces(batch.column(1), PIECE_BYTES):
                made = _rearranged(texts, draws[at : at + len(texts)], rate, suffix_first)
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), *made], names)

    return rows.mapInArrow(run, schema)


def restored(form: Column, output: Column) -> Column:
    """The text that ``infill`` made ``output`` of."""
    parts = F.split(output, "<[PSM]>", -1)
    piece = lambda *order: F.concat(*[F.get(parts, F.lit(k)) for k in order])
    return F.when(form == "psm", piece(1, 3, 2)).when(form == "spm", piece(2, 3, 1)).otherwise(output)


def digest(made: DataFrame) -> DataFrame:
    """Rows of ``infill`` with the SHA-256 of the output and of the text restored from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))
