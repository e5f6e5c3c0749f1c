"""Near-duplicates by ProbMinHash sketches, banding and exact verification.

A document is a weighted set of five-word shingles, weight 1 + ln(occurrences).
For each shingle a Poisson process with the weight as its rate throws marks at
the sketch's registers; a register keeps the shingle of its earliest mark, so
two registers agree with the probability Jaccard similarity of the documents.
The process of a shingle ends as soon as its next mark comes too late for every
register.

Two texts are linked if they share a band of registers and the exact probability
Jaccard similarity of their whole weighted sets reaches the threshold. Classes are
the connected components of the links, and no link is left out:

1. Identical texts are one from the start and only one of them goes on.
2. Every bucket (texts that share a band) has one centre, the member that meets
   the most texts in its buckets; every other member is compared with it. Most
   links' components follow from these stars, at one comparison a member and bucket.
3. What is left are buckets whose members lie in several components. Two linked
   texts share a rare shingle among their rarest ones (prefix filter), or all that
   they share is frequent. The former pairs come from an inverted index over rare
   shingles, whose lists are short by definition. For the latter the weight of
   the rare shingles, which cannot be common, and what either text lacks of the
   bucket's centre bound the similarity from above (see ``_bound``); only pairs
   that the bound lets pass are formed, bucket cell by bucket cell, and compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, keep, mix64

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: A pair beyond the stars is verified if at least this share of registers agrees. At a
#: similarity of 0.8 that misses fewer than one pair in ten million.
ESTIMATE = 0.6
#: A shingle is rare if at most so many of the texts left after the stars hold it; the
#: others are left to the bound, so nothing hangs on this number but speed.
RARE = 100
#: Members of a large bucket that one cell of its joins holds, about.
PART = 256
#: Parts that the nodes of one label are dealt into.
SALTS = 16
#: For rounding errors of weights and similarities.
SPARE = 1e-6
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hashes of words, computed once."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles(texts: list[str], known: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight), sorted, of distinct shingles. A text of one to
    four words is one shingle; one without words has none."""
    docs, hashes = [], []
    for i, text in enumerate(texts):
        words = text.split()
        n = len(words)
        if not n:
            continue
        w = np.fromiter(map(known.__getitem__, words), np.uint64, n)
        size = min(SHINGLE, n)
        h = np.full(n - size + 1, size, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                h = mix64(h * _GOLD + w[k : n - size + 1 + k])
        docs.append(np.full(len(h), i, np.int64))
        hashes.append(h)
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    d, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])]))
    counts = np.diff(np.append(first, len(d)))
    return d[first], h[first], 1 + np.log(counts)


def sketch(n_docs: int, d: np.ndarray, h: np.ndarray, w: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """(n_docs, m) registers with the shingle of the earliest mark; rows of documents without shingles are 0.

    Marks later than a document's horizon are not made; where a register is
    still empty then, the horizon was too near and is doubled.
    """
    out = np.zeros((n_docs, m), np.uint64)
    total = np.bincount(d, w, n_docs)
    horizon = np.where(total > 0, m * (np.log(m) + 4) / np.maximum(total, 1e-300), 0)
    todo = np.ones(len(d), bool)
    while todo.any():
        doc, key, rate = d[todo], h[todo], w[todo]
        state, t = key.copy(), np.zeros(len(doc))
        slots, times, keys = [], [], []
        while len(doc):
            with np.errstate(over="ignore"):
                state = state + _GOLD
            r = mix64(state)
            t = t - np.log(((r >> np.uint64(11)) + 0.5) * 2.0**-53) / rate
            live = t <= horizon[doc]
            doc, key, rate, state, t = doc[live], key[live], rate[live], state[live], t[live]
            slots.append(doc * m + (mix64(r[live] ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(m)).astype(np.int64))
            times.append(t)
            keys.append(key)
        slot, time, key = map(np.concatenate, (slots, times, keys))
        latest_first = np.argsort(-time, kind="stable")
        best = np.zeros(n_docs * m, np.uint64)
        full = np.zeros(n_docs * m, bool)
        best[slot[latest_first]] = key[latest_first]
        full[slot] = True
        whole = full.reshape(n_docs, m).all(1)
        out[whole] = best.reshape(n_docs, m)[whole]
        todo &= ~whole[d]
        horizon = np.where(whole, 0, 2 * horizon)
    return out


def similarity(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard of two sorted weighted sets; for equal weights it is plain Jaccard."""
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = wa[i], wb[j]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    r = x / y
    # for shingle k: sum over l of max(x_l / x_k, y_l / y_k); the first is the larger where r_l >= r_k
    at = np.searchsorted(r, r, side="left")
    below_y = np.concatenate([[0], np.cumsum(y)])[at]
    from_x = x.sum() - np.concatenate([[0], np.cumsum(x)])[at]
    return float((1 / ((from_x + only_a) / x + (below_y + only_b) / y)).sum())


def _pieces(batch: pa.RecordBatch, column: int, chars: int = 1_000_000) -> Iterator[tuple[int, int, list[str]]]:
    """(from, to, texts) so that a piece has a bounded number of characters, or one text."""
    texts: list[str] = []
    start = held = 0
    for k, value in enumerate(batch.column(column)):
        t = value.as_py() or ""
        if texts and held + len(t) > chars:
            yield start, k, texts
            texts, start, held = [], k, 0
        texts.append(t)
        held += len(t) + 64
    if texts:
        yield start, batch.num_rows, texts


def _key() -> Column:
    """The identity of a text: its MD5, as bytes. Null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def _named(doc_id: str) -> Column:
    """A doc_id as a text that is never null, to join by."""
    return F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit(""))


def weighted_sets(docs: DataFrame) -> DataFrame:
    """(fp, hashes, weights) of rows (fp, text): sorted distinct shingles as packed
    arrays; weights are empty where all are 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            for a, b, texts in _pieces(batch, 1):
                d, h, w = shingles(texts, known)
                ends = np.searchsorted(d, np.arange(len(texts) + 1))
                hs = [h[i:j].astype("<u8").tobytes() for i, j in zip(ends, ends[1:], strict=False)]
                ws = [w[i:j].astype("<f4").tobytes() if (w[i:j] != 1).any() else b"" for i, j in zip(ends, ends[1:], strict=False)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(hs, pa.binary()), pa.array(ws, pa.binary())], ["fp", "hashes", "weights"])
                if len(known) > 250_000:
                    known.clear()

    return docs.select("fp", "text").mapInArrow(run, "fp binary, hashes binary, weights binary")


def _set(hashes: pa.Scalar, weights: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    h, w = np.frombuffer(hashes.as_py(), "<u8"), np.frombuffer(weights.as_py(), "<f4").astype(float)
    return h, w if len(w) else np.ones(len(h))


def _likely(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, ra, rb) that share a band and whose registers agree often enough, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BANDS, ROWS) for k in (2, 3))
            same = x == y
            yield batch.select(["a", "b"]).filter(pa.array((same.mean((1, 2)) >= ESTIMATE) & same.all(2).any(1)))

    return pairs.select("a", "b", "ra", "rb").mapInArrow(run, "a binary, b binary")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similarity, lacks) of pairs (a, b): the exact similarity, and how many shingles of b are not in a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                (ha, wa), (hb, wb) = (_set(batch.column(c)[k], batch.column(c + 1)[k]) for c in (2, 4))
                out.append((similarity(ha, wa, hb, wb), len(hb) - len(np.intersect1d(ha, hb, assume_unique=True))))
            alike, lacks = zip(*out, strict=True) if out else ((), ())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(alike, pa.float64()), pa.array(lacks, pa.int32())], ["a", "b", "similarity", "lacks"])

    with_a = pairs.join(sets.select(F.col("fp").alias("a"), F.col("hashes").alias("ha"), F.col("weights").alias("wa")), "a")
    both = with_a.join(sets.select(F.col("fp").alias("b"), F.col("hashes").alias("hb"), F.col("weights").alias("wb")), "b")
    return both.select("a", "b", "ha", "wa", "hb", "wb").mapInArrow(run, "a binary, b binary, similarity double, lacks int")


def _spread(sets: DataFrame) -> DataFrame:
    """(fp, shingle, weight) of packed sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                h, w = _set(batch.column(1)[k], batch.column(2)[k])
                yield pa.record_batch([batch.column(0).take(pa.array(np.full(len(h), k))), pa.array(h.view(np.int64)), pa.array(w)], ["fp", "shingle", "weight"])

    return sets.select("fp", "hashes", "weights").mapInArrow(run, "fp binary, shingle long, weight double")


def _bound(total_a: Column, only_a: Column, only_b: Column, top_b: Column) -> Column:
    """At least the similarity of a and b, if a's shingles outside b weigh ``only_a``
    or more and b's outside a ``only_b`` or more.

    The similarity is the sum over common shingles k of 1 / sum_l max(a_l / a_k, b_l / b_k).
    The inner sum is at least A / a_k + only_b / b_k, A being a's total; weights are at
    least 1 and at most ``top_b`` in b, so each term is at most a_k / (A + only_b / top_b),
    and the a_k of common shingles add up to A - only_a at most.
    """
    return (total_a - only_a) / (total_a + only_b / top_b)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, label): the least fp of each node's connected component.

    Each round a node takes the least label around it and then its label's own
    label, so the distance to the least one shrinks geometrically. Minima are
    combined before the shuffle: a node with many links costs no more.
    """
    both = keep(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels, last = nodes.select("fp", "label"), None
    if both.isEmpty():
        discard(both)
        return nodes
    while True:
        around = both.join(labels.select(F.col("fp").alias("b"), "label"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("label").alias("near"))
        taken = labels.join(around, "fp", "left").select("fp", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        # all nodes of one label follow the least that any of them saw; a large label's nodes are dealt over salts
        lowest = taken.where("label < old").groupBy(F.col("old").alias("was")).agg(F.min("label").alias("to")).withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = taken.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
        moved = keep(salted.join(lowest, (F.col("old") == F.col("was")) & (F.col("salt") == F.col("of")), "left").select("fp", "old", F.least("label", F.coalesce("to", "label")).alias("label")), "labels")
        discard(last)
        labels = last = moved
        if moved.where("label < old").isEmpty():
            discard(both)
            return labels


def _parts(n: str = "n") -> Column:
    """Number of parts that a bucket of n members is cut into."""
    return F.ceil(F.col(n) / PART).cast("int")


def residual_pairs(held: DataFrame, sets: DataFrame, compared: DataFrame, threshold: float) -> DataFrame:
    """(a, b): every pair of texts of different components that share a bucket and may be linked.

    ``held`` has the members (bucket, part, n, fp, label, c, hub) of all buckets with
    several components; ``c`` is the bucket's centre, ``hub`` the centre's label.
    """
    loss = 1 - threshold
    members = keep(held.select("fp", "label").distinct(), "members")
    spread = _spread(members.select("fp").join(sets, "fp"))
    df = keep(spread.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "df")
    weighed = keep(spread.join(df, "shingle", "left").select("fp", "shingle", "weight", F.coalesce("df", F.lit(1)).alias("df")), "weighed")
    rare = F.col("df") <= RARE
    facts = weighed.groupBy("fp").agg(F.sum("weight").alias("total"), F.max("weight").alias("top"), F.sum(F.when(rare, F.col("weight")).otherwise(0.0)).alias("own"), F.count(F.when(rare & (F.col("df") > 1), 1)).alias("some"))
    facts = keep(facts, "facts")
    # linked texts share at least 1 - loss of either one's weight, hence their rarest
    # common shingle stands before each one's rarest shingles outweigh the loss
    rarest = Window.partitionBy("fp").orderBy("df", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    ahead = weighed.withColumn("ahead", F.coalesce(F.sum("weight").over(rarest), F.lit(0.0))).where(rare & (F.col("df") > 1)).join(facts.select("fp", "total"), "fp")
    postings = keep(ahead.where(F.col("ahead") <= loss * F.col("total") + SPARE).select("shingle", "fp").join(members, "fp"), "postings")
    x, y = (postings.select("shingle", F.col("fp").alias(k), F.col("label").alias(f"l{k}")) for k in ("a", "b"))
    by_rare = x.join(y, "shingle").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb"))).select("a", "b")
    # without a common rare shingle all rare ones of either text lie outside the other, so they must not outweigh the loss
    lacking = compared.select(F.col("a").alias("fp"), F.col("b").alias("c"), "lacks")
    core = held.join(facts.where(F.col("own") <= loss * F.col("total") + SPARE), "fp").join(lacking, ["fp", "c"], "left").join(facts.select(F.col("fp").alias("c"), F.col("some").alias("c_some")), "c")
    core = keep(core.withColumn("lacks", F.coalesce("lacks", F.lit(0))).select("bucket", "part", "n", "fp", "label", "hub", "total", "top", "own", "lacks", "c_some"), "core")
    # a large bucket is a grid of cells: every text outside the centre's component meets every part
    grid = F.sequence(F.lit(0), _parts() - 1)
    names = ("fp", "label", "total", "top", "own", "lacks")
    x = core.where("label != hub").select("bucket", F.col("part").alias("row"), F.explode(grid).alias("column"), "hub", "c_some", *[F.col(k).alias(f"{k}_a") for k in names])
    y = core.select("bucket", F.explode(grid).alias("row"), F.col("part").alias("column"), *[F.col(k).alias(f"{k}_b") for k in names])
    # what b lacks of the centre and a does not, a has and b has not, but for the centre's own rare shingles
    lack = lambda p, q: F.greatest(F.lit(0), F.col(f"lacks_{q}") - F.col(f"lacks_{p}") - F.col("c_some"))
    only_a, only_b = F.col("own_a") + lack("a", "b"), F.col("own_b") + lack("b", "a")
    bound = F.least(_bound(F.col("total_a"), only_a, only_b, F.col("top_b")), _bound(F.col("total_b"), only_b, only_a, F.col("top_a")))
    may = (F.col("label_a") != F.col("label_b")) & ((F.col("label_b") == F.col("hub")) | (F.col("fp_a") < F.col("fp_b"))) & (bound >= threshold - SPARE)
    by_core = x.join(y, ["bucket", "row", "column"]).where(may).select(F.least("fp_a", "fp_b").alias("a"), F.greatest("fp_a", "fp_b").alias("b"))
    pairs = keep(by_rare.union(by_core).distinct(), "pairs")
    discard(members, df, weighed, facts, postings, core)
    return pairs


def _linked(compared: DataFrame, threshold: float) -> DataFrame:
    return compared.where(F.col("similarity") >= threshold - 1e-9).select("a", "b")


def _merged(now: DataFrame, mixed: DataFrame, centres: DataFrame, copies: DataFrame, sets: DataFrame, compared: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """The labels after all links that the stars have not compared; ``now`` has the
    members of buckets with their labels, ``mixed`` the buckets with several components."""
    hubs = centres.join(mixed, "bucket").join(labels.select(F.col("fp").alias("c"), F.col("label").alias("hub")), "c").select("bucket", "part", "c", "hub")
    held = keep(now.join(hubs, ["bucket", "part"]), "held")
    pairs = residual_pairs(held, sets, compared, threshold)
    done = compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    marks = copies.select("fp", "marks")
    fresh = pairs.join(done, ["a", "b"], "left_anti").join(marks.select(F.col("fp").alias("a"), F.col("marks").alias("ra")), "a").join(marks.select(F.col("fp").alias("b"), F.col("marks").alias("rb")), "b")
    more = keep(_compared(_likely(fresh), sets), "compared")
    merged = components(labels, _linked(more, threshold))
    discard(held, pairs, more)
    return merged


def classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, fp, class_id, kept) of every row of ``docs``.

    A class is a connected component of the links between distinct texts (two texts
    that share a band of registers and reach the threshold) with all their copies.
    ``class_id`` is the least doc_id of the class; ``kept`` marks the class's one
    representative text's rows with that doc_id. Null texts are empty, and all texts
    without any character are copies of one another; texts with white space only are
    copies if they are identical. A null doc_id takes part but names no class unless
    all of the class are null.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("fp"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sk = keep(sketches(base), "sketches")
    copies = keep(sk.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("marks").alias("marks")), "copies")
    each = copies.where("bands is not null").select("fp", F.explode("bands").alias("bucket"))
    sizes = keep(each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    shared = each.join(sizes, "bucket")
    reach = shared.groupBy("fp").agg(F.sum("n").alias("reach"))
    buckets = keep(shared.join(reach, "fp").select("bucket", F.pmod(F.xxhash64("fp"), _parts()).cast("int").alias("part"), "n", "fp", "reach"), "buckets")
    discard(sizes)
    centres = buckets.groupBy("bucket").agg(F.max(F.struct("reach", "fp")).alias("c"), F.max("n").alias("n"))
    centres = keep(centres.select("bucket", F.explode(F.sequence(F.lit(0), _parts() - 1)).alias("part"), F.col("c.fp").alias("c")), "centres")
    stars = keep(buckets.join(centres, ["bucket", "part"]).where("fp != c").select(F.col("fp").alias("a"), F.col("c").alias("b")).distinct(), "stars")
    nodes = keep(buckets.groupBy("fp").agg(F.lit(1).alias("one")).join(copies.select("fp", "least"), "fp").select("fp", "least"), "nodes")
    # the text of one row for each text of a bucket; copies are dealt by their doc_id too,
    # and by a shuffle at any size, as the buckets' texts grow with the corpus
    wanted = nodes.select("fp", _named("least").alias("of")).hint("merge")
    one = base.select("fp", _named("doc_id").alias("of"), "text").join(wanted, ["fp", "of"], "left_semi").dropDuplicates(["fp", "of"])
    sets = keep(weighted_sets(one), "sets")
    compared = keep(_compared(stars, sets), "compared")
    labels = components(nodes.select("fp", F.col("fp").alias("label")), _linked(compared, threshold))
    # buckets that still hold several components; of two members, the star has compared both
    now = buckets.where("n > 2").join(labels, "fp").select("bucket", "part", "n", "fp", "label")
    mixed = keep(now.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("bucket"), "mixed")
    merged = labels if mixed.isEmpty() else _merged(now, mixed, centres, copies, sets, compared, labels, threshold)
    discard(buckets, centres, stars, sets, compared, mixed, None if merged is labels else labels)
    named = copies.select("fp", "least").join(merged, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    class_ids = named.groupBy("label").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("rep"))
    by_fp = named.join(class_ids, "label").select("fp", F.col("rep.least").alias("class_id"), (F.col("fp") == F.col("rep.fp")).alias("is_rep"))
    return sk.select("doc_id", "fp").join(by_fp, "fp").select("doc_id", "fp", "class_id", (F.col("is_rep") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys of sketches: equal in a column where all registers of the band are."""
    rows = regs.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=np.uint64)), rows.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = mix64(key * _GOLD + rows[:, :, k])
    return key


def sketches(base: DataFrame) -> DataFrame:
    """(doc_id, fp, bands, marks) of rows (doc_id, fp, text): the keys of a sketch's
    bands and a byte of each register; null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            for a, b, texts in _pieces(batch, 2):
                d, h, w = shingles(texts, known)
                regs, some = sketch(len(texts), d, h, w), np.zeros(len(texts), bool)
                some[d] = True
                keys, low = band_keys(regs).view(np.int64), (regs & np.uint64(255)).astype(np.uint8)
                bands = pa.array([k if ok else None for k, ok in zip(keys, some, strict=True)], pa.list_(pa.int64()))
                marks = pa.array([m.tobytes() if ok else None for m, ok in zip(low, some, strict=True)], pa.binary())
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), bands, marks], ["doc_id", "fp", "bands", "marks"])
                if len(known) > 250_000:
                    known.clear()

    return base.select("doc_id", "fp", "text").mapInArrow(run, "doc_id long, fp binary, bands array<long>, marks binary")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, kept: one row for each row of ``docs``."""
    return classes(docs).select("doc_id", "class_id", "kept")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate class, all columns as they are: the one with the
    least doc_id, and of several such rows that with the least hash of all columns."""
    kept = classes(docs).where("kept").select(F.col("fp").alias("__key"), _named("doc_id").alias("__of")).distinct()
    keyed = docs.select(_key().alias("__key"), _named("doc_id").alias("__of"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    # a text's class keeps one doc_id, so the join's keys serve the aggregation too
    rows = keyed.join(kept, ["__key", "__of"], "left_semi").groupBy("__key", "__of")
    return rows.agg(F.min_by("__row", F.xxhash64("__row")).alias("__row")).select("__row.*")
