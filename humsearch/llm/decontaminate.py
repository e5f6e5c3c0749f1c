"""Benchmark decontamination by latent semantic retrieval.

Benchmark texts are cut into passages, which are dealt by hash into blocks. The
TF-IDF matrix of the passages (document frequencies counted over the whole corpus)
gets a randomised SVD, block by block: each block is a task of Spark's, and its
factors fold windows of every document into the block's latent space, where cosine
similarity finds the passages they may contain. A candidate is confirmed by the
longest common subsequence of words, weighted by squared IDF: by itself if nearly
the whole passage is there, and for paraphrases together with the passage's answer.

The latent space of a block has as many dimensions as passages, so the product of
a window and a passage is exact in it: the sum of squared IDF of the words they
share, which no common subsequence outweighs. So no confirmed window is missed,
whatever else stands in it. Words' weights follow from the corpus and the whole
benchmark, so how passages are dealt changes no verdict.

Thousands of passages are worked off in one scan of the corpus for document
frequencies and one for the search; a larger benchmark takes such pairs of scans
by groups of items, so what goes to the executors stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import keep

WINDOW, STRIDE = 64, 16
#: Longest passage; every run of this many words lies within one window.
PASSAGE = WINDOW - STRIDE
#: Passages in a block of the benchmark, about; its latent space has a dimension for each.
BLOCK_PASSAGES = 205
#: Passages that one pair of scans of the corpus serves, about. Their factors take some
#: 25 KB a passage in every Python worker.
GROUP_PASSAGES = 8192
#: For rounding errors, in shares of a passage's weight.
SPARE = 0.01
#: Share of the passage's weight (sum of squared IDF) in the common subsequence: alone, and if the answer is found too.
WHOLE, PARAPHRASE = 0.75, 0.5
ANSWER_WORDS = 5
#: Words in a larger share of the benchmark's passages get no weight.
COMMON = 0.05


_MARKS = ".,;:!?\"()[]{}"


#: Characters that are worked on at a time, unless one text has more.
PIECE_CHARS = 1_000_000


def _plain(raw: pa.Array) -> pa.Array:
    """Words lower-cased, without punctuation marks around them."""
    return pc.utf8_trim(pc.utf8_lower(raw), characters=_MARKS)


def words(text: str | None) -> list[str]:
    """Words between white space, lower-cased, without punctuation marks around them."""
    raw = pc.utf8_split_whitespace(pa.array([text or ""], pa.string())).flatten()
    return [w for w in _plain(raw).to_pylist() if w]


def coded(texts: pa.Array, vocabulary: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, ids, ends) for pieces of bounded length or of one text: the
    numbers of all its words in the vocabulary, -1 outside it, text by text, and
    where each text's begin and the last one's end."""
    texts = pc.fill_null(texts, "")
    chars = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(chars, (int(chars[at - 1]) if at else 0) + PIECE_CHARS, side="right")))
        lists = pc.utf8_split_whitespace(texts.slice(at, to - at))
        # each distinct word is looked up once
        found = pc.dictionary_encode(lists.flatten())
        plain = _plain(found.dictionary)
        number = np.asarray(pc.fill_null(pc.index_in(plain, vocabulary), -1)).astype(np.int32)
        number[np.asarray(pc.equal(plain, ""))] = -2
        ids = number[np.asarray(found.indices)]
        ends = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
        real = ids > -2
        yield at, ids[real], np.concatenate([[0], np.cumsum(real)])[ends]
        at = to


@dataclass
class Model:
    """What is needed to search one block of the benchmark; its size follows the block
    only, but for ``place``: a word's number in the group to its number here, -1 for none."""

    place: np.ndarray
    idf: np.ndarray
    projection: np.ndarray  # term -> latent, with IDF
    latent: np.ndarray  # passage -> latent, length 1
    norm: np.ndarray  # length of each passage in latent space
    item: list[int]
    passages: list[np.ndarray]
    answers: list[np.ndarray]
    weight: np.ndarray  # sum of squared IDF of each passage
    least: float = field(default=0.0)

    def __post_init__(self) -> None:
        self.least = PARAPHRASE * float(self.weight.min()) if len(self.weight) else np.inf


@dataclass
class Group:
    """The words that the blocks of a group know, and the blocks' models."""

    words: list[str]
    models: list[Model]


def _cut(text: str, answer: str | None) -> list[tuple[list[str], list[str]]]:
    """(words, answer words): a text of up to PASSAGE words whole, a longer one in
    passages that end with the text; the answer is the given one or the last words."""
    w = words(text)
    if not w:
        return []
    starts = sorted({*range(0, max(1, len(w) - PASSAGE + 1), PASSAGE), max(0, len(w) - PASSAGE)})
    given = words(answer)
    return [(w[a : a + PASSAGE], given or w[a : a + PASSAGE][-ANSWER_WORDS:]) for a in starts]


def passages(benchmark: DataFrame) -> DataFrame:
    """(item_id, part, words, answer) of benchmark rows (item_id, text and perhaps answer).
    Items with a null id or without words have none; repeated ids count as one item
    with all their texts."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer")).where("item_id is not null and text is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, h, p, a) for i, h, t, given in zip(*(c.to_pylist() for c in batch.columns), strict=True) for p, a in _cut(t, given)]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], ["item_id", "text", "words", "answer"])

    cut = items.select("item_id", F.xxhash64("text", "answer").alias("of"), "text", "answer").mapInArrow(run, "item_id long, text long, words array<string>, answer array<string>")
    return cut.select("item_id", F.xxhash64("item_id", "text", "words").alias("part"), "words", "answer")


def usual_words(cut: DataFrame) -> list[str]:
    """Words that many passages of the benchmark use tell none of them and get no
    weight, unless some passage has no others. Fewer than PASSAGE / COMMON words."""
    n = cut.count()
    uses = cut.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count()
    usual = [r["word"] for r in uses.where(F.col("count") > max(3.0, COMMON * n)).collect()]
    if not usual:
        return []
    only = cut.where(F.size(F.array_except("words", F.array(*map(F.lit, usual)))) == 0)
    needed = {r["word"] for r in only.select(F.explode("words").alias("word")).distinct().collect()}
    return sorted(set(usual) - needed)


def document_frequencies(docs: DataFrame, known: list[str]) -> tuple[np.ndarray, int]:
    """In how many documents each word stands, and the number of documents."""
    size = len(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n, terms = np.zeros(size, np.int64), 0, pa.array(known, pa.string())
        for batch in batches:
            for _, ids, ends in coded(batch.column(0), terms):
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    here = np.zeros(size + 1, bool)
                    here[ids[a:b]] = True
                    seen += here[:-1]
            n += batch.num_rows
        some = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(seen[some], n))], ["term", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    total = 0
    for r in rows:
        if r["term"] < 0:
            total = r["n"]
        else:
            out[r["term"]] = r["n"]
    return out, total


def randomised_svd(rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int, rank: int, seed: int = 7) -> np.ndarray:
    """Right singular vectors (n_terms, rank) of a sparse matrix given as rows (terms, values).

    Three passes, each a sum over rows: sketch A'(A O) with Gaussian O, one
    power iteration, and the Gram matrix of A Q, whose eigenvectors turn Q.
    """
    right = np.random.default_rng(seed).standard_normal((n_terms, min(rank, n_terms)))
    for _ in range(2):
        out = np.zeros_like(right)
        for t, v in rows:
            np.add.at(out, t, np.outer(v, v @ right[t]))
        right, _ = np.linalg.qr(out)
    seen = np.array([v @ right[t] for t, v in rows])
    _, vectors = np.linalg.eigh(seen.T @ seen)
    return right @ vectors[:, ::-1]


_MODEL = "terms binary, projection binary, latent binary, norm binary, item array<bigint>, passages array<array<int>>, answers array<array<int>>"


def fit(cut: DataFrame, known: list[str], idf: np.ndarray) -> list[Model]:
    """The model of each block of passages (block, item_id, part, words, answer), a task for each."""
    number = {w: k for k, w in enumerate(known)}

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("item_id", "ascending"), ("part", "ascending")])
        whole, answers = ([np.array([number[w] for w in x], np.int32) for x in group.column(c).to_pylist()] for c in ("words", "answer"))
        terms = np.unique(np.concatenate(whole + answers))
        local, answers = ([np.searchsorted(terms, x) for x in xs] for xs in (whole, answers))
        weight = idf[terms]
        rows = [(t, n * weight[t]) for t, n in (np.unique(x, return_counts=True) for x in local)]
        projection = (weight[:, None] * randomised_svd(rows, len(terms), len(rows))).astype(np.float32)
        latent = np.array([projection[x].sum(0) for x in local])
        norm = np.maximum(np.linalg.norm(latent, axis=1), 1e-6).astype(np.float32)
        packed = [x.tobytes() for x in (terms.astype("<i4"), projection, (latent / norm[:, None]).astype(np.float32), norm)]
        lists = pa.list_(pa.list_(pa.int32()))
        return pa.table([[x] for x in packed] + [pa.array([group.column("item_id").to_pylist()], pa.list_(pa.int64())), pa.array([[x.tolist() for x in local]], lists), pa.array([[x.tolist() for x in answers]], lists)], [c.split()[0] for c in _MODEL.split(", ")])

    models = []
    for r in cut.groupBy("block").applyInArrow(run, _MODEL).collect():
        terms, norm = np.frombuffer(r["terms"], "<i4"), np.frombuffer(r["norm"], np.float32)
        place = np.full(len(known) + 1, -1, np.int32)  # the last one is for unknown words
        place[terms] = np.arange(len(terms))
        local = [np.array(x, np.int32) for x in r["passages"]]
        latent = np.frombuffer(r["latent"], np.float32).reshape(len(norm), -1)
        projection = np.frombuffer(r["projection"], np.float32).reshape(len(terms), -1)
        models.append(Model(place, idf[terms], projection, latent, norm, r["item"], local, [np.array(x, np.int32) for x in r["answers"]], np.array([(idf[terms][x] ** 2).sum() for x in local])))
    return models


def common_weight(window: np.ndarray, passage: np.ndarray, idf: np.ndarray) -> float:
    """Weight of the heaviest common subsequence of words."""
    best = np.zeros(len(window) + 1)
    for t in passage:
        step = np.where(window == t, best[:-1] + idf[t] ** 2, 0.0)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], step))
    return float(best[-1])


def _has(window: np.ndarray, answer: np.ndarray) -> bool:
    """True if the answer's words stand together in the window."""
    n = len(answer)
    if not n or n > len(window):
        return False
    return bool((np.lib.stride_tricks.sliding_window_view(window, n) == answer).all(1).any())


def search(group: Group, texts: pa.Array) -> list[tuple[int, int, float, float, bool, int]]:
    """(text, item, cosine, common share, answer found, first word) of every confirmed item: its best window."""
    found: dict[tuple[int, int], tuple[float, float, bool, int]] = {}
    for first, ids, ends in coded(texts, pa.array(group.words, pa.string())):
        for model in group.models:
            _search_piece(model, model.place[ids], ends, first, found)
    return [(t, i, *v) for (t, i), v in sorted(found.items())]


def _search_piece(model: Model, ids: np.ndarray, ends: np.ndarray, first: int, found: dict) -> None:
    # strides of STRIDE words, counted from each text's start; a window is WINDOW / STRIDE of them
    per = WINDOW // STRIDE
    strides = [np.arange(a, b, STRIDE) for a, b in zip(ends, ends[1:], strict=False)]
    sizes = np.array([len(x) for x in strides])
    if not sizes.sum():
        return
    start = np.concatenate(strides)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    last = np.repeat(np.cumsum(sizes), sizes)  # stride after the text's last
    number = np.arange(len(start))
    begins = (number + per <= last) | (number == last - np.repeat(sizes, sizes))
    known = np.flatnonzero((ids >= 0) & (model.idf[ids] > 0))
    mass = np.concatenate([[0.0], np.cumsum(np.where(ids >= 0, model.idf[ids] ** 2, 0.0))])
    stop = np.minimum(start + WINDOW, ends[doc + 1])
    # a common subsequence weighs no more than all of the window's known words
    live = np.flatnonzero(begins & (mass[stop] - mass[start] >= model.least))
    if not len(live):
        return
    wanted = np.zeros(len(start) + per, bool)
    for k in range(per):
        wanted[live + k] = True
    wanted[: len(start)][number >= last] = False
    of = np.searchsorted(start, known, side="right") - 1
    keep_ = wanted[of]
    known, of = known[keep_], of[keep_]
    vectors = np.zeros((len(start) + per, model.projection.shape[1]), np.float32)
    if len(known):
        heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        vectors[of[heads]] = np.add.reduceat(model.projection[ids[known]], heads, axis=0)
    for at in range(0, len(live), 4096):
        w = live[at : at + 4096]
        window = vectors[w]
        for k in range(1, per):
            window = window + np.where((w + k < last[w])[:, None], vectors[w + k], 0)
        dot = window @ model.latent.T
        length = np.linalg.norm(window, axis=1, keepdims=True)
        # the product bounds the weight of any common subsequence
        hit = dot * model.norm >= (PARAPHRASE - SPARE) * model.weight
        for row, p in zip(*np.nonzero(hit), strict=True):
            i = w[row]
            text, passage, weight = ids[start[i] : stop[i]], model.passages[p], model.weight[p]
            # words that both have bound the subsequence; most candidates end here
            present = set(text.tolist())
            if sum(model.idf[t] ** 2 for t in passage.tolist() if t in present) < PARAPHRASE * weight:
                continue
            share = common_weight(text, passage, model.idf) / weight
            if share < PARAPHRASE:
                continue
            answer = _has(text, model.answers[p])
            if share >= WHOLE or answer:
                key = (first + int(doc[i]), model.item[p])
                new = (float(dot[row, p] / max(length[row, 0], 1e-12)), float(share), answer, int(start[i] - ends[doc[i]]))
                if key not in found or new[1] > found[key][1]:
                    found[key] = new


def groups(docs: DataFrame, benchmark: DataFrame, block_passages: int = BLOCK_PASSAGES, group_passages: int = GROUP_PASSAGES) -> Iterator[Group]:
    """The benchmark in groups of items, each with the models of its blocks. Items with a
    null id or without words take no part; repeated ids count as one item with all
    their texts."""
    cut = keep(passages(benchmark), "passages")
    n = cut.count()
    if not n:
        return
    many = -(-n // group_passages)
    # items are dealt by hash, so a group or block may hold somewhat more; a block's rank follows
    blocks = max(1, -(-n // (many * block_passages)))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("item_id"), F.lit(many))).withColumn("block", F.pmod(F.xxhash64("part", F.lit(1)), F.lit(blocks)).cast("int"))
    usual = usual_words(cut)
    for g in range(many):
        own = dealt.where(F.col("group") == g)
        known = sorted(r["word"] for r in own.select(F.explode(F.concat("words", "answer")).alias("word")).distinct().collect())
        if known:
            df, size = document_frequencies(docs, known)
            idf = np.log((size + 1) / (df + 1)) + 0.05
            idf[np.isin(known, usual)] = 0
            yield Group(known, fit(own, known, idf))


MATCHES = "doc_id long, item_id long, cosine double, common double, answer boolean, first_word int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_passages: int = BLOCK_PASSAGES, group_passages: int = GROUP_PASSAGES) -> DataFrame:
    """doc_id, item_id, cosine, common, answer, first_word: one row for each
    document row and benchmark item that it holds. Null and empty texts hold
    none; an empty benchmark is found nowhere."""
    out = docs.sparkSession.createDataFrame([], MATCHES)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for group in groups(docs, benchmark, block_passages, group_passages):

        def run(batches: Iterator[pa.RecordBatch], group: Group = group) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = search(group, batch.column(1))
                t, item, cosine, common, answer, first = zip(*got, strict=True) if got else [[]] * 6
                ids = batch.column(0).take(pa.array(t, pa.int64()))
                yield pa.record_batch([ids, pa.array(item, pa.int64()), pa.array(cosine, pa.float64()), pa.array(common, pa.float64()), pa.array(answer, pa.bool_()), pa.array(first, pa.int32())], [x.split()[0] for x in MATCHES.split(", ")])

        out = out.union(narrow.mapInArrow(run, MATCHES))
    return out


def holds_leak(group: Group):
    """A function of a text column: whether it holds an item of the group."""

    def run(text: pd.Series) -> pd.Series:
        hit = np.zeros(len(text), bool)
        hit[[t for t, *_ in search(group, pa.array(text, pa.string(), from_pandas=True))]] = True
        return pd.Series(hit)

    run.__annotations__ = {"text": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.BooleanType())


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are."""
    out = docs
    for group in groups(docs, benchmark):
        out = out.where(~holds_leak(group)(F.col("text").cast("string")))
    return out
