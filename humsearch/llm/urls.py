"""URL filters: host and path rules, and association rules for all other urls.

The rule list decides what it covers. Its decisions are the labels from which
Spark's FP-growth mines combinations of url tokens; rules that reach the least
support and confidence, without those that a shorter rule makes useless, are
matched through an inverted index from token to rule. Only DataFrame operations
and Spark's own miner run.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .common import keep

#: (rule, verdict): host, then the beginning of the path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SUPPORT, CONFIDENCE = 0.01, 0.6
_VERDICT = "verdict="


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: from there up to ``?``, ``#`` or the end. Both empty for
    null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def listed_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is tested last and wins
        of, slash, begins = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + begins)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens, sorted: scheme, top domain, two-label domain, first label,
    file extension and fragment, one of each; every host label, every path part
    and every query key."""
    one = {
        "scheme": F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)),
        "top": F.substring_index(host, ".", -1),
        "domain": F.substring_index(host, ".", -2),
        "first": F.substring_index(host, ".", 1),
        "ext": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1),
        "fragment": F.when(F.instr(url, "#") > 0, F.lit("yes")).otherwise(F.lit("")),
    }
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    each = {
        "label": F.split(host, r"\."),
        "part": F.transform(F.split(path, "/"), lambda x: F.regexp_replace(x, r"[0-9]+", "#")),
        "key": F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)),
    }

    def named(kind: str, values: Column) -> Column:
        held = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x != "")
        return F.transform(held, lambda x: F.concat(F.lit(kind + "="), x))

    made = [named(k, F.array(v)) for k, v in one.items()] + [named(k, v) for k, v in each.items()]
    return F.array_sort(F.array_distinct(F.concat(*made)))


def alike(sets: DataFrame, least: float) -> list[list[str]]:
    """Tokens that stand in at least ``least`` urls of ``sets`` (items, verdict, n), and
    together those that stand in the very same urls. A url has few tokens, so the
    least support bounds the list, whatever the number of urls."""
    each = sets.select(F.explode("items").alias("item"), "n", F.xxhash64("items", "verdict").alias("h"), F.xxhash64("verdict", "items", F.lit(1)).alias("g"))
    held = each.groupBy("item").agg(F.sum("n").alias("n"), F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g")).where(F.col("n") >= least)
    return [sorted(r[0]) for r in held.groupBy("n", "h", "g").agg(F.collect_list("item")).drop("n", "h", "g").collect()]


_RULES = "rule_id long, items array<string>, size int, verdict string, confidence double, support double"


def surest_below(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(items, below): the greatest confidence of any rule of a proper subset, for each
    frequent item set that has one.

    Every subset of a frequent set is frequent, so it is enough to look at the subsets of
    one item less, size by size: their own rules and what lies below them.
    """
    own = rules.groupBy("items").agg(F.max("confidence").alias("own"))
    table = keep(sets.join(own, "items", "left").withColumn("size", F.size("items")), "sure")
    longest = table.agg(F.max("size")).first()[0] or 0
    out, last = None, table.where("size = 1").select("items", F.col("own").alias("best"))
    for size in range(2, longest + 1):
        here = table.where(F.col("size") == size)
        parts = here.select("items", "own", F.explode(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.filter("items", lambda x, j: j != i))).alias("part"))
        below = parts.join(last.select(F.col("items").alias("part"), "best"), "part").groupBy("items", "own").agg(F.max("best").alias("below"))
        level = keep(below, "below")
        last = level.select("items", F.greatest("own", "below").alias("best"))
        found = level.where("below is not null").select("items", "below")
        out = found if out is None else out.union(found)
    return out if out is not None else table.where("false").select("items", F.col("own").alias("below"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Pruned rules (rule_id, items, size, verdict, confidence, support) from (items, verdict).

    Only the least support bounds what is mined. Items that stand in the very
    same urls go to the miner as one, and each rule that is left is written for
    every one of them. A rule falls if a rule of a proper subset of its items is
    at least as confident, for either verdict.
    """
    spark = labelled.sparkSession
    sets = keep(labelled.groupBy("items", "verdict").agg(F.count("*").alias("n")), "sets")
    groups = {g[0]: g for g in alike(sets, support * (sets.agg(F.sum("n")).first()[0] or 0))}
    if not groups:
        return spark.createDataFrame([], _RULES)
    known = F.array(*[F.lit(x) for x in sorted(groups)])
    baskets = keep(labelled.select(F.concat(F.array_intersect("items", known), F.array(F.concat(F.lit(_VERDICT), "verdict"))).alias("items")), "baskets")
    n = baskets.count()
    model = FPGrowth(itemsCol="items", minSupport=support).fit(baskets)
    said = lambda x: x.startswith(_VERDICT)
    frequent = model.freqItemsets.select(F.array_sort(F.filter("items", lambda x: ~said(x))).alias("items"), F.get(F.filter("items", said), F.lit(0)).alias("said"), "freq")
    frequent = keep(frequent.where(F.size("items") > 0), "frequent")
    alone = frequent.where("said is null").select("items", F.col("freq").alias("of"))
    held = frequent.where("said is not null").join(alone, "items").withColumn("confidence", F.col("freq") / F.col("of")).where(F.col("confidence") >= confidence)
    rules = keep(held.select("items", F.size("items").alias("size"), F.substring("said", len(_VERDICT) + 1, 100).alias("verdict"), "confidence", (F.col("freq") / F.lit(n)).alias("support")), "rules")
    beaten = rules.join(surest_below(alone.select("items"), rules), "items").where("below >= confidence").select("items", "verdict")
    left = rules.join(beaten, ["items", "verdict"], "left_anti")
    more = [g for g in groups.values() if len(g) > 1]
    if more:
        members = F.map_from_arrays(F.array(*[F.lit(g[0]) for g in more]), F.array(*[F.array(*[F.lit(x) for x in g]) for g in more]))
        names = lambda x: F.coalesce(F.element_at(members, x), F.array(x))
        every = F.aggregate("items", F.array(F.array().cast("array<string>")), lambda made, x: F.flatten(F.transform(made, lambda m: F.transform(names(x), lambda y: F.concat(m, F.array(y))))))
        left = left.withColumn("items", F.explode(every)).withColumn("items", F.array_sort("items"))
    return left.select(F.xxhash64("items", "verdict").alias("rule_id"), "items", "size", "verdict", "confidence", "support")


def match(signatures: DataFrame, rules: DataFrame) -> DataFrame:
    """(items, mined_verdict, confidence, mined_rule): the best rule for each distinct
    item set that any rule fits. Best: confidence, then support, then size, then text.

    The index holds a rule under its rarest item only, so an item set meets few rules
    that don't fit it, however frequent some of its items are.
    """
    held = signatures.select("items", F.explode("items").alias("item"))
    uses = held.groupBy("item").agg(F.count("*").alias("uses"))
    each = rules.select("rule_id", F.explode("items").alias("item")).join(uses, "item", "left")
    rarest = each.groupBy("rule_id").agg(F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "item")).alias("r")).select("rule_id", "r.item")
    index = rules.join(rarest, "rule_id").select("item", F.col("items").alias("needed"), "size", "verdict", "confidence", "support")
    full = held.join(index, "item").where(F.size(F.array_except("needed", "items")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), (-F.col("size")).alias("z"), F.array_join("needed", " ").alias("text"), "verdict")).alias("best")
    return full.groupBy("items").agg(best).select("items", F.col("best.verdict").alias("mined_verdict"), (-F.col("best.c")).alias("confidence"), F.col("best.text").alias("mined_rule"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, confidence: one row for each row of ``pages``.

    The verdict is the listed rule's, else that of the best mined rule that fits,
    else ``default``. Null urls have no host; without any listed page nothing is
    mined and the default holds.
    """
    url = F.col("url")
    narrow = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = host_and_path(url)
    parsed = narrow.withColumn("host", host).withColumn("path", path)
    rule, said = listed_rule(F.col("host"), F.col("path"), rules)
    table = keep(parsed.withColumn("rule", rule).withColumn("said", said).withColumn("items", F.coalesce(tokens(url, F.col("host"), F.col("path")), F.array().cast("array<string>"))).drop("url"), "urls")
    mined = keep(mine(table.where("said is not null").select("items", F.col("said").alias("verdict"))), "mined")
    # rules meet each distinct item set once, not each page
    verdicts = match(table.where("said is null").select("items").distinct(), mined)
    open_pages = table.where("said is null").join(verdicts, "items", "left").select("page_id", "host", "path", "rule", F.coalesce("mined_verdict", F.lit(default)).alias("verdict"), "mined_rule", "confidence")
    ruled = table.where("said is not null").select("page_id", "host", "path", "rule", F.col("said").alias("verdict"), F.lit(None).cast("string").alias("mined_rule"), F.lit(None).cast("double").alias("confidence"))
    return ruled.unionByName(open_pages)
