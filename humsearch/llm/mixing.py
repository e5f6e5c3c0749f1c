"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, target
words / source words. The whole part is certain; the fraction is rounded
dependently: two fractional documents exchange *words* at random, in proportion
such that both expectations stay, until one of them is integral. The other one
meets the next document. So a source's words stay exactly at their target until
its last document is rounded.

The exchange runs as a reduction tree. Documents are dealt by hash into blocks
of bounded size within their source; a block is folded by a higher-order
function and leaves at most one fractional document, and those residuals are
the next level's input. Only DataFrame operations run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, keep

WEIGHTS = (5, 2, 1)
MOST = 3
#: Mean number of documents in a block of the reduction tree.
BLOCK = 256
#: Copies of a repeated row that are written together.
PIECE = 256
_TINY = 1e-9


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, source_size, n_docs).

    Sources rank by code point, null last, and take the weights in turn. All
    words are shared by weight; no target exceeds ``most`` times its source's
    size, and what it leaves is shared among the rest. That is water-filling:
    in order of ``most * size / weight`` a source is capped as long as its share
    of what the capped ones before it leave is more than its cap. One row for
    each source is ordered, never documents.
    """
    ranked = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "k")
    total = F.sum("source_size").over(Window.partitionBy())
    filled = (
        ranked.withColumn("w", w)
        .withColumn("cap", F.col("source_size") * float(most))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_from_here", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (total - F.col("caps_before")) / F.col("w_from_here"))
        .withColumn("is_capped", F.col("level") * F.col("w") >= F.col("cap"))
    )
    # the first uncapped source's level holds for all after it
    level = F.min(F.when(~F.col("is_capped"), F.struct("cap_rank", "level"))).over(Window.partitionBy())["level"]
    return (
        filled.withColumn("cap_rank", F.row_number().over(order))
        .withColumn("common", level)
        .select("source", "source_size", "n_docs", F.when(F.col("common").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("common") * F.col("w"))).alias("target"))
    )


def _unit(*columns: Column) -> Column:
    """A number in (0, 1) fixed by the columns."""
    return ((F.shiftrightunsigned(F.xxhash64(*columns), 12) + F.lit(0.5)) / F.lit(float(1 << 52))).cast("double")


_DOC = "struct<id:string,size:double,p:double>"


def _fold(docs: Column, seed: int) -> Column:
    """Fold an array of (id, size, p) into (rest, done): the fractional document
    that is left (null if none) and the decided ones with p 0 or 1."""
    start = F.struct(F.lit(None).cast(_DOC).alias("rest"), F.array().cast(f"array<{_DOC}>").alias("done"))

    def settled(d: Column) -> Column:
        return (d["p"] <= _TINY) | (d["p"] >= 1 - _TINY)

    def doc(d: Column, p: Column) -> Column:
        return F.struct(d["id"].alias("id"), d["size"].alias("size"), p.alias("p")).cast(_DOC)

    def rounded(d: Column) -> Column:
        return doc(d, F.round(d["p"]).cast("double"))

    def step(state: Column, d: Column) -> Column:
        a = state["rest"]
        # up: words that can move from d to a; down: from a to d
        up = F.least((1 - a["p"]) * a["size"], d["p"] * d["size"])
        down = F.least(a["p"] * a["size"], (1 - d["p"]) * d["size"])
        rise = _unit(a["id"], d["id"], F.lit(seed)) < down / (up + down)
        move = F.when(rise, up).otherwise(-down)
        a2, d2 = doc(a, a["p"] + move / a["size"]), doc(d, d["p"] - move / d["size"])
        both = F.array(a2, d2)
        done = F.transform(F.filter(both, settled), rounded)
        left = F.get(F.filter(both, lambda x: ~settled(x)), F.lit(0))
        return F.when(a.isNull(), F.struct(d.alias("rest"), state["done"].alias("done"))).otherwise(F.struct(left.alias("rest"), F.concat(state["done"], done).alias("done")))

    return F.aggregate(docs, start, step)


def round_pivotal(parts: DataFrame, counts: dict[str, int] | None = None, most_in_group: int = 0, block: int = BLOCK) -> DataFrame:
    """(source, id, extra 0/1) for rows (source, id string unique, size double > 0, p in (0, 1), n_docs).

    ``most_in_group`` is the largest ``n_docs``: it sets the number of levels.
    """
    levels, n = 1, most_in_group
    while n > block:
        n, levels = -(-n // block) + 1, levels + 1
    rows = parts.select("source", "n_docs", F.struct(F.col("id").cast("string").alias("id"), F.col("size").cast("double").alias("size"), F.col("p").cast("double").alias("p")).cast(_DOC).alias("d"))
    decided, blocks = [], F.ceil(F.col("n_docs") / block).cast("long")
    for level in range(levels):
        last = level == levels - 1
        number = F.lit(0).cast("long") if last else F.pmod(F.xxhash64(F.col("d.id"), F.lit(level)), F.greatest(F.lit(1), blocks))
        # larger documents first, so that what is left at the end is small
        ordered = F.array_sort(F.collect_list("d"), lambda x, y: F.when(x["size"] > y["size"], -1).when(x["size"] < y["size"], 1).when(x["id"] < y["id"], -1).when(x["id"] > y["id"], 1).otherwise(0))
        folded = rows.groupBy("source", "n_docs", number.alias("block")).agg(_fold(ordered, level).alias("f"))
        folded = keep(folded, "mixing")
        decided.append(folded.select("source", F.explode("f.done").alias("d")))
        rows = folded.where(F.col("f.rest").isNotNull()).select("source", "n_docs", F.col("f.rest").alias("d"))
        blocks = F.ceil(blocks / block).cast("long")
    coin = F.when(_unit(F.col("d.id"), F.lit(-1)) < F.col("d.p"), 1.0).otherwise(0.0)
    decided.append(rows.select("source", F.struct("d.id", "d.size", coin.alias("p")).cast(_DOC).alias("d")))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out.select("source", "d.id", F.col("d.p").cast("long").alias("extra"))


def _row_key(docs: DataFrame) -> Column:
    """The same for rows that are equal in every column."""
    return F.sha2(F.to_json(F.struct(*docs.columns)), 256)


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(row_key, doc_id, source, size, times, source_size, target, copies): ``times``
    equal rows of the input that are taken ``copies`` times each.

    Rows that are equal in every column share a key and can't be told apart, so
    reruns agree. Of ``times * p`` expected extra copies the whole part is certain
    and goes to as many of those rows, and one row is rounded for what is left.
    Null texts have no words; documents without words get no copies.
    """
    sized = keep(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), _row_key(docs).alias("row_key")), "sizes")
    rows = sized.groupBy("row_key").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("times"))
    rows = keep(rows, "sizes")
    sources = keep(targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.count("*").alias("n_docs")), weights, most), "targets")
    # one row for each source; Spark broadcasts it by its own size check and splits a hot source if it can't
    held = rows.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    share = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    held = held.drop("of").withColumn("share", share).withColumn("whole", F.floor(F.col("share") + _TINY)).withColumn("p", F.greatest(F.lit(0.0), F.col("share") - F.col("whole")))
    held = held.withColumn("sure", F.floor(F.col("times") * F.col("p") + _TINY)).withColumn("left", F.greatest(F.lit(0.0), F.col("times") * F.col("p") - F.col("sure")))
    open_rows = held.where((F.col("left") > _TINY) & (F.col("size") > 0)).select("source", "n_docs", F.col("row_key").alias("id"), "size", F.col("left").alias("p"))
    largest = sources.agg(F.max("n_docs")).first()[0] or 0
    extra = round_pivotal(open_rows, most_in_group=int(largest)).select(F.col("id").alias("row_key"), "extra")
    some = F.col("sure") + F.coalesce(F.col("extra"), F.lit(0))
    shares = F.when(F.col("size") > 0, F.array(F.struct(some.cast("long").alias("times"), (F.col("whole") + 1).cast("long").alias("copies")), F.struct((F.col("times") - some).cast("long").alias("times"), F.col("whole").cast("long").alias("copies")))).otherwise(F.array(F.struct(F.col("times").cast("long").alias("times"), F.lit(0).cast("long").alias("copies"))))
    return held.join(extra, "row_key", "left").withColumn("of", F.explode(F.filter(shares, lambda x: x["times"] > 0))).select("row_key", "doc_id", "source", "size", "of.times", "source_size", "target", "of.copies")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row for each row of ``docs``."""
    # a row's repeats are dealt out in pieces, which other tasks write
    pieces = plan(docs).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(PIECE).cast("long")))).repartition("row_key", "piece")
    again = pieces.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(PIECE).cast("long"), F.col("times") - F.col("piece")))))
    return again.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, all columns as they are."""
    columns = docs.columns
    p = plan(docs).groupBy("row_key").agg(F.sum("times").alias("__times"), F.sum(F.col("times") * F.col("copies")).alias("__copies"))
    held = docs.withColumn("__key", _row_key(docs)).join(keep(p.where("__copies > 0").withColumnRenamed("row_key", "__key"), "taken"), "__key")
    again = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n))
    single = held.where("__times = 1").withColumn("__k", again(F.col("__copies"))).select(*columns)
    # equal rows are gathered to one, whose copies are dealt out in pieces
    one = held.where("__times > 1").groupBy("__key").agg(F.first(F.struct(*columns)).alias("__row"), F.first("__copies").alias("__copies"))
    pieces = one.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1, F.lit(PIECE).cast("long")))).repartition("__key", "__piece")
    repeated = pieces.withColumn("__k", again(F.least(F.lit(PIECE).cast("long"), F.col("__copies") - F.col("__piece")))).select("__row.*")
    return single.unionByName(repeated)
