"""Token-ID output: one wavelet matrix for each shard of the corpus.

A shard holds the ids of whole documents in ascending ``doc_id`` order. Its
payload is a wavelet matrix: the ids are renumbered by the shard's sorted
alphabet, and each bit of those numbers, highest first, is one plane; after a
plane the positions are stably parted into zeros and ones. A directory of
running counts makes rank constant-time and select a binary search, so the one
file answers access, counting and occurrence lookup without being expanded.

Shards are rows of a Parquet table with one shard a file, written through
Spark's committer: a lost executor or a repeated task leaves no half file.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import shared_dir

END_ID = 1
#: A shard is closed at this many tokens; only a document longer than that makes a larger one.
SHARD_TOKENS = 1 << 20
BLOCK = 512  # bits between two entries of the rank directory
SHARD_SCHEMA = "part int, shard int, first_doc long, n_docs int, n_tokens long, doc_ids binary, lengths binary, alphabet binary, zeros binary, planes binary, ranks binary"


class WaveletMatrix:
    """Sequence of integers with access, rank (count before a position) and select."""

    def __init__(self, n: int, alphabet: np.ndarray, zeros: np.ndarray, planes: np.ndarray, ranks: np.ndarray):
        self.n, self.alphabet, self.zeros, self.planes, self.ranks = n, alphabet, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        present = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
        present[ids] = True
        alphabet = np.flatnonzero(present).astype(np.uint32)
        order = np.zeros(len(present), np.uint32)
        order[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
        x = order[ids].astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        n, depth = len(x), max(0, int(len(alphabet) - 1).bit_length())
        width = -(-n // BLOCK) * BLOCK // 8
        planes, zeros = np.zeros((depth, width), np.uint8), np.zeros(depth, np.int64)
        for level in range(depth):
            bit = (x >> (depth - 1 - level) & 1).astype(bool)
            packed = np.packbits(bit)
            planes[level, : len(packed)] = packed
            x = np.concatenate([low := x[~bit], x[bit]])
            zeros[level] = len(low)
        ones = np.bitwise_count(planes).reshape(depth, -1, BLOCK // 8).sum(2, dtype=np.uint32) if depth and n else np.zeros((depth, 0), np.uint32)
        ranks = np.zeros((depth, ones.shape[1] + 1), np.uint32)
        np.cumsum(ones, axis=1, out=ranks[:, 1:])
        return cls(n, alphabet, zeros, planes, ranks)

    def _ones(self, level: int, pos: int) -> int:
        """Ones before ``pos``."""
        block, rest = divmod(pos, BLOCK)
        row = self.planes[level, block * BLOCK // 8 : block * BLOCK // 8 + BLOCK // 8]
        return int(self.ranks[level, block]) + int(np.unpackbits(row)[:rest].sum())

    def _nth(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) ``bit``, by binary search in the directory."""
        counts = self.ranks[level].astype(np.int64)
        if not bit:
            counts = np.arange(len(counts), dtype=np.int64) * BLOCK - counts
        block = int(np.searchsorted(counts, k, side="right")) - 1
        row = np.unpackbits(self.planes[level, block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(row == bit)[k - counts[block]])

    def access(self, pos: int) -> int:
        """The id at a position."""
        if not 0 <= pos < self.n:
            raise IndexError(pos)
        value = 0
        for level in range(len(self.planes)):
            ones = self._ones(level, pos)
            bit = int(np.unpackbits(self.planes[level, pos // 8 : pos // 8 + 1])[pos % 8])
            value = value * 2 + bit
            pos = int(self.zeros[level]) + ones if bit else pos - ones
        return int(self.alphabet[value])

    def _code(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def rank(self, token: int, pos: int) -> int:
        """How often ``token`` stands before ``pos``."""
        if (code := self._code(token)) is None:
            return 0
        start, end = 0, min(pos, self.n)
        for level in range(len(self.planes)):
            a, b = self._ones(level, start), self._ones(level, end)
            if code >> (len(self.planes) - 1 - level) & 1:
                start, end = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                start, end = start - a, end - b
        return end - start

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``token``."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        code, start = self._code(token), 0
        depth = len(self.planes)
        for level in range(depth):
            ones = self._ones(level, start)
            start = int(self.zeros[level]) + ones if code >> (depth - 1 - level) & 1 else start - ones
        pos = start + k
        for level in reversed(range(depth)):
            if code >> (depth - 1 - level) & 1:
                pos = self._nth(level, 1, pos - int(self.zeros[level]))
            else:
                pos = self._nth(level, 0, pos)
        return pos

    def decode(self) -> np.ndarray:
        """All ids: the last plane's order is undone plane by plane, lowest bit first."""
        depth = len(self.planes)
        dtype = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        x = np.zeros(self.n, dtype)
        for level in reversed(range(depth)):
            bit = np.unpackbits(self.planes[level], count=self.n).astype(bool)
            back = np.empty(self.n, dtype)
            nz = int(self.zeros[level])
            back[~bit] = x[:nz]
            back[bit] = x[nz:] | dtype(1 << (depth - 1 - level))
            x = back
        return self.alphabet[x] if self.n else np.zeros(0, np.uint32)

    def fields(self) -> list[bytes]:
        return [np.ascontiguousarray(a).tobytes() for a in (self.alphabet.astype("<u4"), self.zeros.astype("<i8"), self.planes, self.ranks.astype("<u4"))]

    @classmethod
    def load(cls, n: int, alphabet: bytes, zeros: bytes, planes: bytes, ranks: bytes) -> WaveletMatrix:
        z = np.frombuffer(zeros, "<i8")
        shape = (len(z), -1) if len(z) else (0, 0)
        return cls(n, np.frombuffer(alphabet, "<u4"), z, np.frombuffer(planes, np.uint8).reshape(shape), np.frombuffer(ranks, "<u4").reshape(shape))


#: Marks that may follow a word's letters; no apostrophe, which starts contractions.
_AFTER = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: Latin letters: each is its own composed form, and lower case changes it to one letter.
_LATIN = "".join(c for c in map(chr, range(65, 0x250)) if c.isalpha() and len(c.lower()) == 1 and unicodedata.is_normalized("NFC", c) and unicodedata.normalize("NFKC", c) == c)

# fixed values: the tokenizer file's own rules that encoding by words relies on
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}
#: White space that the tokenizer and Unicode's rule for splitting disagree on.
_SEPARATORS = "[\x1c-\x1f]"
#: Characters that are encoded at a time, unless one text has more.
PIECE_CHARS = 4_000_000


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays end to end, and their lengths."""
    return np.concatenate([np.zeros(0, "<u4"), *parts]), np.fromiter(map(len, parts), np.int64, len(parts))


def _taken(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs numbered ``at``, end to end, of runs that lie end to end in ``flat``."""
    n = sizes[at]
    ends = np.cumsum(n)
    return flat[np.repeat((np.cumsum(sizes) - sizes)[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Ids of texts by a tokenizer file. White space never lies inside a token of
    the given vocabulary's pre-tokenizer, so a piece of many texts is split into
    words and each distinct word is encoded once. A word of Latin letters, then
    marks, is two pieces for the tokenizer, whatever their case: its letters'
    ids are remembered in columns of bounded length, and new ones go to the
    tokenizer together, as one text in which a word's last token alone ends a
    word. Texts with the separators that splitting and the tokenizer disagree on
    are encoded whole, and so are all texts if the file's rules for normalizing and
    splitting are not those that this relies on."""

    def __init__(self, path: str, remembered: int = 200_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        self.tokenizer.no_padding()
        rules = json.loads(self.tokenizer.to_str())
        self.by_words = all(rules.get(k) == v for k, v in RULES.items()) and bool(rules["model"].get("end_of_word_suffix"))
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        # words in lower case, parted by spaces, need no normalizing; none comes twice, so the model needs no memory
        self.bare = Tokenizer.from_file(path)
        self.bare.no_padding()
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if resize := getattr(self.bare.model, "_resize_cache", None):
            resize(0)
        self.words, self.flat, self.sizes = pa.array([""]), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _one(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case words of Latin letters, end to end, and how many each has."""
        ids = np.asarray(self.bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return _joined([self._one(w) for w in words])
        return ids, np.diff(ends, prepend=0)

    def _letters(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, end to end, and how many each has."""
        found = pc.index_in(words, self.words)
        new = pc.filter(words, pc.is_null(found))
        parts = [self._together(new.slice(at, 4096).to_pylist()) for at in range(0, len(new), 4096)]
        flat, sizes = (np.concatenate([old, *(p[k] for p in parts)]) for k, old in enumerate((self.flat, self.sizes)))
        at = np.asarray(pc.fill_null(found, -1)).astype(np.int64)
        at[at < 0] = len(self.words) + np.arange(len(new))
        if len(sizes) <= self.remembered:
            self.words, self.flat, self.sizes = pa.concat_arrays([self.words, new]), flat, sizes
            return _taken(flat, sizes, at), sizes[at]
        # too many: the words of this piece replace all others
        self.words, self.flat, self.sizes = words, _taken(flat, sizes, at), sizes[at]
        return self.flat, self.sizes

    def _piece(self, texts: pa.Array) -> list[np.ndarray]:
        lists = pc.utf8_split_whitespace(texts)
        words = pc.dictionary_encode(lists.flatten())
        raw = words.dictionary
        letters, marks = pc.utf8_rtrim(raw, characters=_AFTER), pc.utf8_ltrim(raw, characters=_LATIN)
        plain = pc.equal(pc.add(pc.utf8_length(letters), pc.utf8_length(marks)), pc.utf8_length(raw))
        odd = pc.filter(raw, pc.invert(plain)).to_pylist()
        letters = pc.dictionary_encode(pc.if_else(plain, pc.utf8_lower(letters), ""))
        marks = pc.dictionary_encode(pc.if_else(plain, marks, ""))
        # a table of ids: letters, marks, other words; each word is an entry of the first or third part, then one of the second
        flat, sizes = self._letters(letters.dictionary)
        others, more = _joined([self._one(w) for w in chain(marks.dictionary.to_pylist(), odd)])
        flat, sizes = np.concatenate([flat, others]), np.concatenate([sizes, more])
        first, second = np.asarray(letters.indices).astype(np.int64), np.asarray(marks.indices).astype(np.int64) + len(letters.dictionary)
        first[~np.asarray(plain)] = len(sizes) - len(odd) + np.arange(len(odd))
        at = np.asarray(words.indices)
        entries = np.stack([first[at], second[at]], 1).ravel()
        ids, ends = _taken(flat, sizes, entries), np.cumsum(sizes[entries])
        offsets = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
        bounds = np.concatenate([[0], ends])[2 * offsets]
        return [ids[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def pieces(self, texts: pa.Array) -> Iterator[list[np.ndarray]]:
        """Ids of texts (null: none), for pieces of bounded length or of one text."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
        at = 0
        while at < len(texts):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + PIECE_CHARS, side="right")))
            part = texts.slice(at, to - at)
            at = to
            if not self.by_words:
                yield [self._one(t) for t in part.to_pylist()]
                continue
            whole = pc.match_substring_regex(part, _SEPARATORS)
            got = self._piece(pc.if_else(whole, "", part))
            for k in np.flatnonzero(np.asarray(whole)):
                got[k] = self._one(part[int(k)].as_py())
            yield got

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return [ids for piece in self.pieces(pa.array(texts, pa.string())) for ids in piece]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, which serves many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID) -> None:
    """Tokenize ``docs`` (doc_id, text) and write one wavelet matrix a file under ``path``.

    Rows are range-partitioned and sorted by doc_id (null first; rows of one
    doc_id by their text's hash). Null and empty texts become the end id alone. Other
    columns play no part. An empty table writes no shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part, shard = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        held = 0
        tail = np.array([end_id], "<u4")

        def flush() -> pa.RecordBatch:
            nonlocal held, shard
            matrix = WaveletMatrix.build(np.concatenate([x for d in ids for x in (d, tail)]))
            lengths = np.array([len(d) + 1 for d in ids], "<i8")
            keys = pa.array(doc_ids, pa.int64())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("doc_id", pa.int64())])) as out:
                out.write_batch(pa.record_batch([keys], ["doc_id"]))
            row = [part, shard, doc_ids[0], len(ids), matrix.n, sink.getvalue().to_pybytes(), lengths.tobytes(), *matrix.fields()]
            shard, held = shard + 1, 0
            ids.clear()
            doc_ids.clear()
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 6]
            names = [x.split()[0] for x in SHARD_SCHEMA.split(", ")]
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            keys = iter(batch.column(0).to_pylist())
            for got in chain.from_iterable(words.pieces(batch.column(1))):
                ids.append(got)
                doc_ids.append(next(keys))
                held += len(got) + 1
                if held >= shard_tokens:
                    yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows of one doc_id go by the text's hash, so that boundaries hold numbers only
    order = ["doc_id", F.xxhash64("text"), "text"]
    rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).mapInArrow(run, SHARD_SCHEMA).write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(path)


def open_shard(row) -> WaveletMatrix:
    """The wavelet matrix of one row of a shard table."""
    return WaveletMatrix.load(row["n_tokens"], row["alphabet"], row["zeros"], row["planes"], row["ranks"])


def read_documents(spark, path: str) -> DataFrame:
    """(part, shard, pos, doc_id, n_tokens, before, ids_crc32) of each document, decoded from the files.

    ``before`` is the number of ids in the same shard that precede the document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                ids = open_shard(row).decode().astype("<u4")
                lengths = np.frombuffer(row["lengths"], "<i8")
                ends = np.cumsum(lengths)
                keys = pa.ipc.open_stream(row["doc_ids"]).read_all().column(0).combine_chunks()
                n, view = len(lengths), memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["shard"], np.int32)), pa.array(np.arange(n, dtype=np.int32)), keys, pa.array(lengths.astype(np.int64)), pa.array((ends - lengths).astype(np.int64)), pa.array(crc, pa.int64())]
                yield pa.record_batch(columns, ["part", "shard", "pos", "doc_id", "n_tokens", "before", "ids_crc32"])

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path).drop("first_doc", "n_docs")
    return shards.mapInArrow(run, "part int, shard int, pos int, doc_id long, n_tokens long, before long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer_path: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the shard files.

    ``start`` comes from a running sum over the shards (one small row for each
    shard's million tokens), joined to the documents by shard.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/wavelet-{uuid.uuid4().hex}"
    write_shards(docs, tokenizer_path, path, shard_tokens)
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path).select("part", "shard", F.col("n_tokens").alias("m"))
    in_part = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("m").alias("m"))
    before_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        shards.withColumn("inside", F.coalesce(F.sum("m").over(in_part), F.lit(0)))
        .join(parts.select("part", F.coalesce(F.sum("m").over(before_part), F.lit(0)).alias("outside")), "part")
        .select("part", "shard", (F.col("inside") + F.col("outside")).alias("offset"))
    )
    return read_documents(spark, path).join(offsets, ["part", "shard"]).select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
