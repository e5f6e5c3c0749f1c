"""Toxicity by weak supervision.

1. Words, beginnings and endings that stand in toxic training texts and hardly in
   others form lexicons. Each lexicon is a voter, and so are patterns of writing:
   some look at what the lexicons find (how much, how dense, shouted, close to a
   second person), some at the text alone (exclaiming, shouting, masked letters,
   drawn-out letters, address). A voter votes toxic or abstains.
2. A generative label model says how votes come about: within either class a voter
   has a rate, and it depends on one other voter, in a tree that is chosen for the
   class by mutual information (Chow and Liu). EM estimates class share, rates and the
   dependences from how the voters vote together on all documents; documents
   that may be learned from count with their label. Sixteen voters have at most
   2 ** 16 vote patterns, so their counts are all that the driver sees.
3. The posterior of each document, labelled or not, is the soft label for a logistic classifier over
   the lexicons' entries found in a text and the votes, which gives the scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import keep, learns, one_label

THRESHOLD = 0.5
#: Expected number of labelled rows that lexicons are mined from, and of rows with
#: votes that the classifier is fit on, at most. Rows are drawn by a hash of doc_id.
SAMPLE_ROWS = 20_000
MIN_DOCS, MIN_PRECISION, HIGH_PRECISION = 4, 0.9, 0.98
#: Buckets of the classifier's hashed lexicon entries.
BUCKETS = 256
#: English insults as a seed lexicon, which the mined ones extend.
SEED = frozenset("idiot moron stupid trash scum loser clown pathetic worthless disgusting".split())
#: Second persons of some languages.
SECOND = frozenset("you your yours yourself du dich dir dein deine deinen euch tu te toi ton ta tes vous votre vos usted ustedes ti tus".split())
LEXICONS = ("word", "fair_word", "start4", "start5", "start6", "end4", "seed")
VOTERS = (*LEXICONS, "two_entries", "dense", "shouted_entry", "entry_near_you", "exclaiming", "shouting", "masked", "drawn_out", "address")
_BIT = {name: 1 << k for k, name in enumerate(VOTERS)}
_MARKS = ".,;:!?\"'()[]{}*%$#&|"
_MASKED, _DRAWN = re.compile(r"[^\W\d_][*@$#]+[^\W\d_]"), re.compile(r"([^\W\d_])\1\1")


def terms(word: str) -> tuple[str, ...]:
    """A lower-cased word without marks around it, its beginnings and its ending, as lexicon entries."""
    w = word.lower().strip(_MARKS)
    if not w:
        return ()
    return (f"word={w}", *[f"start{k}={w[:k]}" for k in (4, 5, 6) if len(w) >= k], *([f"end4={w[-4:]}"] if len(w) >= 6 else []))


_LEXICAL = sum(_BIT[v] for v in LEXICONS)
#: What a word is, beside its votes: shouted, in capitals, a second person.
_SHOUTED, _CAPITAL, _SECOND = (1 << len(VOTERS) + k for k in range(3))


class _Found(dict):
    """Word as it stands -> its votes, and whether it is shouted, in capitals or a second
    person, as bits. ``entries`` has the plain form and the buckets of words with lexicon entries."""

    def __init__(self, lexicon: dict[str, bool]):
        super().__init__()
        self.entries: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.kinds: dict[str, dict[str, bool]] = {k: {} for k in ("word", "start4", "start5", "start6", "end4")}
        for term, precise in lexicon.items():
            kind, _, rest = term.partition("=")
            self.kinds[kind][rest] = precise

    def __missing__(self, word: str) -> int:
        plain, bits, held = word.lower().strip(_MARKS), 0, []
        n, kinds = len(plain), self.kinds
        for kind, part in (("word", plain), ("start4", plain[:4]), ("start5", plain[:5]), ("start6", plain[:6]), ("end4", plain[-4:])):
            # a beginning or ending counts in words that are long enough for it, as in ``terms``
            if part in kinds[kind] and (kind == "word" or n >= (6 if kind == "end4" else int(kind[-1]))):
                bits |= _BIT["fair_word" if kind == "word" and not kinds[kind][part] else kind]
                held.append(xxhash.xxh3_64_intdigest(f"{kind}={part}".encode("utf-8", "surrogatepass")) & (BUCKETS - 1))
        if plain in SEED:
            bits |= _BIT["seed"]
        if bits:
            self.entries[word] = (plain, tuple(held))
        # letters that are masked or drawn out stand within one word
        if not word.isalpha() and _MASKED.search(word):
            bits |= _BIT["masked"]
        if _DRAWN.search(word):
            bits |= _BIT["drawn_out"]
        if plain in SECOND:
            bits |= _SECOND
        if word.isupper():
            bits |= _SHOUTED | (_CAPITAL if len(word) > 1 else 0)
        elif "!" in word:
            bits |= _SHOUTED
        if len(self) < 250_000:
            self[word] = bits
        return bits


#: Characters that are worked on at a time, unless one text has more.
PIECE_CHARS = 1_000_000


def read(texts: pa.Array, found: _Found) -> Iterator[tuple[np.ndarray, list[list[int]]]]:
    """(votes as bits, buckets of the entries found) of whole texts, null as empty, for
    pieces of bounded length or of one text. A piece's distinct words are looked at
    once; the rest are sums over the words' numbers."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + PIECE_CHARS, side="right")))
        yield _read_piece(texts.slice(at, to - at), found)
        at = to


def _read_piece(texts: pa.Array, found: _Found) -> tuple[np.ndarray, list[list[int]]]:
    n = len(texts)
    lists = pc.utf8_split_whitespace(texts)
    coded = pc.dictionary_encode(lists.flatten())
    raw = coded.dictionary.to_pylist()
    known = np.fromiter(map(found.__getitem__, raw), np.int64, len(raw))
    word, doc = np.asarray(coded.indices), np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets)))
    real = np.asarray(pc.not_equal(coded.dictionary, ""))[word]
    word, doc = word[real], doc[real]
    bits = known[word]
    entry, second, capital, shouted = ((bits & mask) != 0 for mask in (_LEXICAL, _SECOND, _CAPITAL, _SHOUTED))
    size = np.bincount(doc, minlength=n)
    count = lambda mask: np.bincount(doc[mask], minlength=n)
    votes = np.zeros(n, np.int64)
    voted = bits & ((1 << len(VOTERS)) - 1)
    np.bitwise_or.at(votes, doc[voted != 0], voted[voted != 0])
    entries, loud, yours = count(entry), count(capital), count(second)
    marks = np.asarray(pc.count_substring(texts, "!"))
    near = np.zeros(n, bool)
    for apart in range(4):
        a, b = slice(0, len(doc) - apart), slice(apart, len(doc))
        both = ((entry[a] & second[b]) | (second[a] & entry[b])) & (doc[a] == doc[b])
        near[doc[a][both]] = True
    buckets: list[set[int]] = [set() for _ in range(n)]
    plain: list[set[str]] = [set() for _ in range(n)]
    for d, w in np.unique(np.stack([doc[entry], word[entry]], 1), axis=0).tolist():
        form, places = found.entries[raw[w]]
        buckets[d].update(places)
        plain[d].add(form)
    some = size > 0
    for name, on in (
        ("two_entries", np.array([len(p) >= 2 for p in plain], bool)),
        ("dense", (entries > 0) & (50 * entries >= size)),
        ("shouted_entry", count(entry & shouted) > 0),
        ("entry_near_you", near),
        ("exclaiming", some & (marks > 0) & (50 * marks >= size)),
        ("shouting", (loud > 0) & (10 * loud >= size)),
        ("address", (yours > 0) & (20 * yours >= size)),
    ):
        votes |= np.where(on, _BIT[name], 0)
    if len(found.entries) > 250_000:
        found.clear()
        found.entries.clear()
    return votes, [sorted(b) for b in buckets]


def mine_lexicon(rows: DataFrame) -> dict[str, bool]:
    """Entries that stand in at least MIN_DOCS toxic texts of (text, label), with
    MIN_PRECISION of their texts toxic; whether their precision is high. The sample
    of texts bounds their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            names = [*counts[1], *(t for t in counts[0] if t not in counts[1])]
            for at in range(0, len(names), 50_000):
                part = names[at : at + 50_000]
                yield pa.record_batch([pa.array(part, pa.string()), pa.array([counts[1][t] for t in part], pa.int64()), pa.array([counts[0][t] for t in part], pa.int64())], ["term", "toxic", "other"])
            for c in counts:
                c.clear()

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                inside: set[str] = set()
                for w in set((text or "").split()):
                    if (got := known.get(w)) is None:
                        got = known[w] = terms(w)
                    inside.update(got)
                counts[label].update(inside)
                if len(known) > 150_000:
                    known.clear()
                if len(counts[0]) + len(counts[1]) > 1_000_000:
                    yield from flush()
        yield from flush()

    sums = rows.select(F.col("text").cast("string"), "label").mapInArrow(run, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    share = F.col("toxic") / (F.col("toxic") + F.col("other"))
    return {r["term"]: r["high"] for r in sums.where((F.col("toxic") >= MIN_DOCS) & (share >= MIN_PRECISION)).select("term", (share >= HIGH_PRECISION).alias("high")).collect()}


@dataclass(frozen=True)
class LabelModel:
    """How votes come about in classes 0 and 1: class share, each voter's parent by
    class (-1: none), and its rate by class and by the parent's vote."""

    share: np.ndarray
    parent: np.ndarray  # class x voter
    rate: np.ndarray  # class x parent's vote x voter

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of votes."""
        logs = []
        for c in (0, 1):
            of = np.where(self.parent[c] >= 0, votes[:, np.maximum(self.parent[c], 0)], 0).astype(int)
            rate = self.rate[c][of, np.arange(votes.shape[1])]
            logs.append(np.log(self.share[c]) + np.where(votes > 0, np.log(rate), np.log(1 - rate)).sum(1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))


def dependences(votes: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Each voter's parent in the tree of greatest mutual information, for rows of votes with weights."""
    k = votes.shape[1]
    gain = np.zeros((k, k))
    total = w.sum() + 4
    both = (votes * w[:, None]).T @ votes + 1
    one = w @ votes + 2
    for a in (0, 1):
        for b in (0, 1):
            joint = {(1, 1): both, (1, 0): one[:, None] - both, (0, 1): one[None, :] - both, (0, 0): total - one[:, None] - one[None, :] + both}[a, b]
            left, right = (one if a else total - one)[:, None], (one if b else total - one)[None, :]
            joint = np.maximum(joint, 1e-9)
            gain += joint * np.log(joint * total / (left * right))
    parent, best, todo = np.full(k, -1), np.full(k, -np.inf), set(range(1, k))
    last, by = 0, np.full(k, -1)
    while todo:
        for v in todo:
            if gain[last, v] > best[v]:
                best[v], by[v] = gain[last, v], last
        last = max(todo, key=lambda v: (best[v], -v))
        parent[last] = by[last]
        todo.remove(last)
    return parent


def label_model(patterns: dict[tuple[int, int | None], int], prior: float, n_voters: int = len(VOTERS), leading: int = len(LEXICONS), rounds: int = 200) -> LabelModel:
    """The model from counts of (vote bits, label or None), by EM.

    Rows with a label keep it; the others begin as toxic where one of the first
    ``leading`` voters votes.
    """
    keys = sorted(patterns, key=lambda x: (x[0], -1 if x[1] is None else x[1]))
    n = np.array([patterns[x] for x in keys], float)
    votes = ((np.array([x[0] for x in keys], int)[:, None] >> np.arange(n_voters)) & 1).astype(float).reshape(-1, n_voters)
    known = np.array([np.nan if x[1] is None else x[1] for x in keys], float)
    p = np.where(np.isnan(known), np.where(votes[:, :leading].any(1), 0.9, min(prior, 0.05)), known)
    for _ in range(rounds):
        weights = [n * (1 - p), n * p]
        parent = np.array([dependences(votes, w) for w in weights])
        rate = np.zeros((2, 2, n_voters))
        for c, w in enumerate(weights):
            # a rate is drawn towards the voter's own, by as much as one row counts
            own = (w @ votes + 0.1) / (w.sum() + 0.5)
            rate[c] = own
            for v in np.flatnonzero(parent[c] >= 0):
                of = votes[:, parent[c, v]]
                for b in (0, 1):
                    at = w * (of == b)
                    rate[c, b, v] = (at @ votes[:, v] + own[v]) / (at.sum() + 1)
        rate = np.clip(rate, 1e-4, 1 - 1e-4)
        share = np.array([w.sum() + 1 for w in weights]) / (n.sum() + 2)
        model = LabelModel(share, parent, rate)
        new = np.where(np.isnan(known), model.posterior(votes), known)
        if len(p) == 0 or np.abs(new - p).max() < 1e-6:
            break
        p = new
    return model


def _design(buckets: list[list[int]], bits: np.ndarray) -> np.ndarray:
    x = np.zeros((len(buckets), BUCKETS + len(VOTERS) + 1))
    for i, b in enumerate(buckets):
        x[i, b] = 1
    x[:, BUCKETS:-1] = (bits[:, None] >> np.arange(len(VOTERS))) & 1
    x[:, -1] = 1
    return x


def fit_linear(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.3, steps: int = 25) -> np.ndarray:
    """Logistic regression on soft labels y with row counts n, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        h = (x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (n * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def score_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, one row for each row.

    Null and empty texts hold no entry and get the score of a text without any
    vote. Equal texts get equal scores; a null doc_id is not held out, takes part in
    the counts and is never learned from. Lexicons come from at most about
    ``sample_rows`` labelled training rows, the classifier's weights from as many
    rows with votes; the votes and the label model cover all documents. Without
    toxic labels only the seed lexicon and the patterns vote.
    """
    known = keep(one_label(labels.where(learns()), "toxic"), "toxic")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    prior = min(0.5, (counts.get(1, 0) + 1) / (total + 2))
    drawn = lambda rows, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) < int(1e6 * min(1.0, sample_rows / max(1, rows)))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lexicon = mine_lexicon(text.where(F.col("doc_id").isNotNull()).join(known.where(drawn(total, 1)), "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found(lexicon)
        for batch in batches:
            at = 0
            for bits, buckets in read(batch.column(1), found):
                yield pa.record_batch([batch.column(0).slice(at, len(bits)), pa.array(bits, pa.int32()), pa.array(buckets, pa.list_(pa.int32()))], ["doc_id", "bits", "buckets"])
                at += len(bits)

    votes = keep(text.mapInArrow(run, "doc_id long, bits int, buckets array<int>"), "votes")
    labelled = votes.select("doc_id", "bits").join(known, "doc_id", "left")
    patterns = {(r["bits"], r["label"]): r["count"] for r in labelled.groupBy("bits", "label").count().collect()}
    model = label_model(patterns, prior) if patterns else None
    # the classifier sees a bounded sample of rows that may be learned from; those without votes are alike and counted
    may = votes.where(learns())
    sizes = may.agg(F.count(F.when(F.col("bits") != 0, 1)).alias("some"), F.count(F.when(F.col("bits") == 0, 1)).alias("none")).first()
    part = min(1.0, sample_rows / max(1, sizes["some"]))
    taken = may.where((F.col("bits") != 0) & drawn(sizes["some"], 2)).join(known, "doc_id", "left").groupBy("bits", "buckets", "label").count().collect()
    bits = np.array([r["bits"] for r in taken] + [0], int)
    design = _design([r["buckets"] for r in taken] + [[]], bits)
    n = np.array([r["count"] for r in taken] + [max(1, sizes["none"]) * part], float)
    soft = model.posterior(((bits[:, None] >> np.arange(len(VOTERS))) & 1).astype(float)) if model else np.full(len(bits), prior)
    weights = fit_linear(design, soft, n)

    @F.pandas_udf(T.DoubleType())
    def score(bits: pd.Series, buckets: pd.Series) -> pd.Series:
        out = weights[-1] + ((bits.to_numpy()[:, None] >> np.arange(len(VOTERS))) & 1) @ weights[BUCKETS:-1]
        out += np.array([weights[np.asarray(b, int)].sum() for b in buckets])
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -60, 60))))

    scored = votes.select("doc_id", (~F.coalesce(learns(), F.lit(True))).alias("held_out"), score("bits", "buckets").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
