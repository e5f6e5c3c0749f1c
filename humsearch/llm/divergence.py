"""How the sources of a language differ, by exact whole-number divergences.

Words are counted by (lang, source) group, and each language keeps the terms that
enough of its documents hold. Shares are whole billionths, and a group's divergence
from another is the sum of floor((p - q)^2 / q) over all kept terms, so no result
depends on the order of additions.

All pairs of a language's groups are a square that is tiled: groups are dealt to
blocks, the vocabulary to chunks, and a group's counts within a chunk are one packed
vector (places, counts). Each vector is sent to the tasks of all tiles that its block
takes part in; a task computes the submatrix of two blocks over its chunk, some
thousand terms at a time, and the chunks' submatrices are added up. Terms that no
group of either block has are not walked through: each of them adds the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, keep

#: A term counts if at least so many documents of its language hold it.
LEAST_DOCS = 3
UNIT = 1_000_000_000
#: Groups of a block and terms of a chunk. A task holds two blocks' vectors of a chunk, 12 bytes an entry.
GROUPS, CHUNK = 32, 1 << 15
#: Terms that a task computes with at a time.
STRIP = 2048
#: The best terms of a group that are reported.
MOST_TERMS = 200
#: Bytes of text that are counted together, unless one text has more.
PIECE_BYTES = 8_000_000

# fixed values: letters of ASCII and all bytes beyond it belong to terms, and only A to Z become lower-case
_TERM_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def _spaced(texts: pa.Array) -> pa.Array:
    """The texts in lower case, with a space for each byte that belongs to no term."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return pa.Array.from_buffers(pa.large_string(), len(raw), [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(_TERM_BYTES[data].tobytes())])


def _counted(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """(lang, source, term, count, docs) of some documents."""
    lists = pc.split_pattern(_spaced(texts), " ")
    doc, words = np.asarray(pc.list_parent_indices(lists)).astype(np.int64), pc.list_flatten(lists)
    some = pc.not_equal(words, "")
    doc, words = doc[np.asarray(some)], pc.dictionary_encode(pc.filter(words, some))
    lang, source = pc.dictionary_encode(langs), pc.dictionary_encode(sources)
    group = np.asarray(lang.indices).astype(np.int64) * len(source.dictionary) + np.asarray(source.indices)
    size = max(1, len(words.dictionary))
    # a document's terms, then a group's: so many documents hold the term
    keys, times = np.unique(doc * size + np.asarray(words.indices), return_counts=True)
    both, back, docs = np.unique(group[keys // size] * size + keys % size, return_inverse=True, return_counts=True)
    count = np.zeros(len(both), np.int64)
    np.add.at(count, back, times)
    of, term = both // size, both % size
    taken = [lang.dictionary.take(pa.array(of // len(source.dictionary))), source.dictionary.take(pa.array(of % len(source.dictionary))), words.dictionary.take(pa.array(term)).cast(pa.string())] if len(both) else [pa.array([], pa.string())] * 3
    return pa.record_batch([*taken, pa.array(count, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "count", "docs"])


def _named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): how often each term occurs in a group, and in how many of its rows."""
    from .infill import _pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _pieces(batch.column(2), PIECE_BYTES):
                yield _counted(batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), texts)

    rows = docs.select(_named("lang"), _named("source"), _named("text")).mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(k: Column, size: Column) -> Column:
    """1 + floor(UNIT * k / size), three digits at a time so that no product leaves 64 bits."""
    digits, rest = F.lit(0).cast("long"), k
    for _ in range(3):
        scaled = rest * F.lit(1000).cast("long")
        digits, rest = digits * 1000 + F.call_function("div", scaled, size), scaled % size
    return digits + 1


def _shares(k: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``share`` of arrays."""
    digits, rest = np.zeros(np.broadcast(k, size).shape, np.int64), k
    for _ in range(3):
        scaled = rest * np.int64(1000)
        digits, rest = digits * 1000 + scaled // size, scaled % size
    return digits + 1


def _tile(rows: pa.Table) -> pa.Table:
    """The submatrix of the pairs of two blocks' groups over one chunk, both ways."""
    lang, lo, hi, size = (rows.column(c)[0].as_py() for c in ("lang", "lo", "hi", "size"))
    names, block = rows.column("source").to_pylist(), np.asarray(rows.column("block"))
    total = (np.asarray(rows.column("n")) + np.asarray(rows.column("v")))[:, None]
    first, second = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    value = np.zeros((len(names), len(names)), np.int64)
    if size:
        places = [np.asarray(p.values, np.int64) for p in rows.column("places")]
        counts = [np.asarray(c.values, np.int64) for c in rows.column("counts")]
        present = np.unique(np.concatenate(places))
        strips = [present[at : at + STRIP] for at in range(0, len(present), STRIP)]
        none = _shares(np.ones((1, 1), np.int64), total)
        # what no group of the tile has adds the same for each term
        parts = [(none, size - len(present))] if size > len(present) else []
        for strip in strips:
            dense = np.zeros((len(names), len(strip)), np.int64)
            for row, p, c in zip(dense, places, counts, strict=True):
                a, b = np.searchsorted(p, [strip[0], strip[-1] + 1])
                row[np.searchsorted(strip, p[a:b])] = c[a:b]
            parts.append((_shares(dense + 1, total), 1))
        for p, times in parts:
            for these, those in ((first, second), (second, first)) if lo != hi else ((first, second),):
                for b in those.tolist():
                    gap = p[these] - p[b]
                    value[these, b] += times * (gap * gap // p[b]).sum(1)
    pairs = [(a, b) for a in first.tolist() for b in second.tolist() if a != b]
    pairs += [(b, a) for a, b in pairs] if lo != hi else []
    i, j = np.array(pairs, int).reshape(-1, 2).T
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "source": pa.array([names[k] for k in i], pa.string()), "item": pa.array([names[k] for k in j], pa.string()), "value": pa.array(value[i, j], pa.int64())})


def packed_vectors(docs: DataFrame, least_docs: int = LEAST_DOCS, groups: int = GROUPS, chunk: int = CHUNK) -> DataFrame:
    """One row for each group and chunk of its language's vocabulary: lang, source, n
    (occurrences of kept terms in the group), v and m (kept terms of the language and
    their occurrences), block, blocks, chunk, size (terms of the chunk) and ``terms``, an
    array of (place, count, total, term) of those that the group has, by place.

    A language without kept terms has one chunk of size 0. Written to the shared folder.
    """
    counts = keep(term_counts(docs), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    number = F.monotonically_increasing_id()
    vocabulary = kept.select("lang", "term", "total").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    vocabulary = keep(vocabulary.withColumn("id", number).select("lang", "term", "total", F.expr(f"id div {chunk}").alias("chunk"), (F.col("id") % chunk).cast("int").alias("place")), "vocabulary")
    found = keep(counts.select("lang", "source", "term", "count").join(vocabulary, ["lang", "term"]), "found")
    sizes = vocabulary.groupBy("lang", "chunk").agg(F.count("*").alias("size"), F.sum("total").alias("total"))
    chunks = sizes.groupBy("lang").agg(F.sum("size").alias("v"), F.sum("total").alias("m"), F.collect_list(F.struct("chunk", "size")).alias("chunks"))
    named = docs.select(_named("lang"), _named("source")).distinct()
    langs = named.groupBy("lang").agg(F.ceil(F.count("*") / groups).cast("int").alias("blocks")).join(chunks, "lang", "left")
    whole = found.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    zero = F.lit(0).cast("long")
    nothing = F.array(F.struct(F.lit(-1).cast("long").alias("chunk"), zero.alias("size")))
    each = named.join(whole, ["lang", "source"], "left").join(langs, "lang").repartition("lang", "source")
    each = each.select("lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("v", zero).alias("v"), F.coalesce("m", zero).alias("m"), "blocks", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"), F.explode(F.coalesce("chunks", nothing)).alias("c"))
    packed = found.groupBy("lang", "source", "chunk").agg(F.array_sort(F.collect_list(F.struct("place", "count", "total", "term"))).alias("terms"))
    vectors = keep(each.select("*", "c.chunk", "c.size").drop("c").join(packed, ["lang", "source", "chunk"], "left"), "vectors")
    discard(counts, vocabulary, found)
    return vectors


def pair_divergences(vectors: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of each group from each other of its language."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    entry = lambda field: F.transform(F.coalesce("terms", F.array().cast("array<struct<place:int,count:bigint,total:bigint,term:string>>")), lambda x: x[field])
    sent = vectors.select("lang", "source", "n", "v", "block", "chunk", "size", entry("place").alias("places"), entry("count").alias("counts"), other)
    sent = sent.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other")
    parts = sent.groupBy("lang", "lo", "hi", "chunk").applyInArrow(_tile, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_divergences(vectors: DataFrame) -> DataFrame:
    """(lang, source, item, value): the terms of each group whose share there is above its language's."""
    each = vectors.select("lang", "source", "n", "v", "m", F.explode("terms").alias("t"))
    p, q = share(F.col("t.count") + 1, F.col("n") + F.col("v")), share(F.col("t.total") + 1, F.col("m") + F.col("v"))
    each = each.select("lang", "source", F.col("t.term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    return each.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))


def audit(docs: DataFrame, most_terms: int = MOST_TERMS, **sizes: int) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source).

    Part ``pair`` has each group's divergence from every other source of its
    language, part ``term`` its ``most_terms`` most telling terms; ranks begin at 1
    with the largest value, and ties go by the item's bytes. Null text, lang and source
    are empty. Each row is a document, repeated or not. Other columns play no part;
    an empty table gives no rows, a language of one source no pairs, one without kept
    terms pairs of value 0.
    """
    vectors = packed_vectors(docs, **sizes)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pair_divergences(vectors), "pair").union(ranked(term_divergences(vectors), "term").where(F.col("rank") <= most_terms))
