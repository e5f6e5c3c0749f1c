"""Personal data: candidate spans, boosted trees and a calibrated threshold.

Four base patterns always count. Broader generators propose further spans,
which may overlap: spelled or spaced signs, other separators, numbers without a
plus. Spark's gradient-boosted trees tell personal data among them by format and
neighbourhood. They learn from the base spans themselves, rewritten in ways that
only the generators see. Where the span stood, a rewritten one is a positive
example; the very same string is a negative one where the corpus has numbers that
are none of all this (versions, prices, hex strings, order numbers), so only the
neighbourhood tells the two apart. Telephone numbers without any prefix are positive
where a word such as "call" announces them, else negative. Further negative ones are
rewritten spans with their inner check broken (digits that fail Luhn's check, parts
over 255, no letters in the last label) and the corpus's own candidates that fail
such a check. So no example is a span that the base patterns find, and none that can
be added is negative for being so. Each kind has its threshold, the least score from
which examples held back from training reach the wanted precision. Candidates above
it that overlap no base span are added. Only DataFrame operations and Spark's own
trees run.

Places come from splitting a text at a pattern: the lengths of the pieces
between matches and of the matches add up to code-point offsets.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import keep

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns. A run of the first class can only match from its
# beginning or from where the last match ended, which \G and the look-behinds
# say so that long runs stay linear; possessive signs forbid vain backtracking.
# A card is a longest run of digits with single separators; only runs of 16 to
# 19 digits can pass, so the others need not match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What must stand in a text for a pattern to match at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Broader generators: addresses with spelled or spaced signs, dotted or dashed
#: quads, digit groups with and without a plus.
BROAD = {
    "email": r"(?<![^\s<(\[])[A-Za-z0-9][A-Za-z0-9._%+-]{1,63}(?: ?@ ?| ?[\[(]at[\])] ?)[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9.-])[0-9]{1,3}(?:[.:-][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ ./-]?[0-9]{4}){2}[ ./-]?[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9(+])(?:\+|00)?\(?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ ./-][0-9]{3,5}(?![0-9])",
}
#: What a text with a match of the broader generators holds in any case.
HINTS = {"email": r"@|[\[(]at[\])]", "ip": "[0-9][.:-][0-9]", "card": "[0-9]{4}", "phone": "[0-9][ ./-][0-9]{3}|[)][ ./-][0-9]{3}"}
SPAN = "array<struct<kind:string,start:bigint,end:bigint,said:string,before:string,after:string>>"
#: Neighbourhoods of other numbers that examples are set into, at most for each way of telling.
CONTEXTS = 1_000
PRECISION = 0.995
LEAST_SCORE = 0.8
FEATURES = ("length", "digits", "letters", "dots", "dashes", "spaces", "at", "plus", "groups", "prefixed", "letters_last", "luhn", "octets", "bounded", "joined", "marked", "numbered", "cued", "is_email", "is_ip", "is_card", "is_phone")


def find(text: Column, pattern: str, kind: str) -> Column:
    """All matches of a pattern as an array of spans, leftmost first and non-overlapping.

    Places are running sums of lengths. They are folded in as many groups as a
    group has matches, so n matches cost n times the root of n.
    """
    none = F.array().cast(SPAN)

    def walk(parts: Column) -> Column:
        said_, pieces, size = parts["said"], parts["pieces"], parts["size"]

        def step(state: Column, k: Column) -> Column:
            said, piece = F.get(said_, k), F.get(pieces, k)
            begin = state["at"] + F.length(piece)
            end = begin + F.length(said)
            # the last 12 characters before and the first after tell a candidate's neighbourhood
            span = F.struct(F.lit(kind).alias("kind"), begin.cast("long").alias("start"), end.cast("long").alias("end"), said.alias("said"), F.right(piece, F.lit(12)).alias("before"), F.substring(F.get(pieces, k + 1), 1, 1).alias("after"))
            return F.struct(end.cast("long").alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

        def group(state: Column, first: Column) -> Column:
            last = F.least(first + size, F.size(said_)) - 1
            some = F.aggregate(F.sequence(first, last), F.struct(state["at"].alias("at"), none.alias("spans")), step)
            return F.get(F.transform(F.array(some), lambda x: F.struct(x["at"].alias("at"), F.concat(state["groups"], F.array(x["spans"])).alias("groups"))), F.lit(0))

        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("groups"))
        every = F.aggregate(F.sequence(F.lit(0), F.size(said_) - 1, size), start, group, lambda s: F.flatten(s["groups"]))
        return F.when(F.size(said_) > 0, every).otherwise(none)

    # an array of one, so that both lists are made once and bound
    said = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lists = F.transform(F.array(said), lambda x: F.struct(x.alias("said"), F.when(F.size(x) > 0, F.split(text, pattern, -1)).alias("pieces"), F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x)))).cast("int").alias("size")))
    return F.get(F.transform(lists, walk), F.lit(0))


def luhn(text: Column) -> Column:
    """True if the digits of a text pass the Luhn check."""
    digits = F.reverse(F.regexp_replace(text, "[^0-9]", ""))
    each = F.transform(F.split(digits, ""), lambda d, i: F.when(d == "", 0).otherwise(F.when(i % 2 == 1, F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))).otherwise(d.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def octets(text: Column, sign: str = "[.]") -> Column:
    """True if all parts between the signs are at most 255."""
    return F.forall(F.split(text, sign), lambda p: p.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})?$"))


def digit_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def _passes(kind: str, said: Column) -> Column:
    if kind == "ip":
        return octets(said)
    if kind == "card":
        return digit_count(said).between(16, 19) & luhn(said)
    if kind == "phone":
        return digit_count(said).between(8, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda s: _passes(kind, s["said"])


def base_spans(text: Column) -> Column:
    """The base spans that pass their checks, by kind and start."""
    found = []
    for kind in KINDS:
        spans, need = F.filter(find(text, BASE[kind], kind), _check(kind)), NEEDS[kind]
        found.append(F.when(text.contains(need) if need else text.rlike("[0-9]"), spans).otherwise(F.array().cast(SPAN)))
    return F.concat(*found)


def broad_spans(text: Column) -> Column:
    """Candidates of the broader generators; spans of different kinds may overlap."""
    found = []
    for kind in KINDS:
        found.append(F.when(text.rlike(HINTS[kind]), find(text, BROAD[kind], kind)).otherwise(F.array().cast(SPAN)))
    return F.concat(*found)


#: Words that announce personal data, and words and signs that announce other numbers (fixed values).
CUES = r"mail|phone|tel|call|card|ip|contact"
NUMBERED = r"(?:version|release|order|invoice|item|model|serial|part|page|section|chapter|figure|table|isbn|issn|ref|number|nr|no|id|v)[.:#]? ?$"
NUMBER = r"[0-9]+(?:[.,:/-][0-9]+)*"


def telling() -> dict[str, Column]:
    """How a neighbourhood (before, after) speaks against personal data: part of a longer word
    or number, between signs of code or money, announced as another number."""
    before, after = F.col("before"), F.col("after")
    return {
        "joined": after.rlike(r"^[\p{L}0-9_-]").cast("int") + before.rlike(r"[\p{L}0-9_-]$").cast("int"),
        "marked": after.rlike(r"^[\"'%=/]").cast("int") + before.rlike(r"[\"'$€£#=/] ?$").cast("int"),
        "numbered": F.lower(before).rlike(r"(?<![a-z])" + NUMBERED).cast("int"),
    }


def features(candidates: DataFrame) -> DataFrame:
    """Format and neighbourhood of each candidate (kind, said, before, after) as columns."""
    s = F.col("said")
    count = lambda pattern: F.length(F.regexp_replace(s, pattern, "")).cast("double")
    columns = {
        "length": F.length(s).cast("double"),
        "digits": count("[^0-9]"),
        "letters": count("[^A-Za-z]"),
        "dots": count("[^.]"),
        "dashes": count("[^-]"),
        "spaces": count("[^ ]"),
        "at": count("[^@]"),
        "plus": count("[^+]"),
        "groups": F.size(F.split(s, "[^0-9A-Za-z]+")).cast("double"),
        "prefixed": s.rlike(r"^(?:[+]|00)").cast("double"),
        "letters_last": s.rlike("[A-Za-z]$").cast("double"),
        "luhn": luhn(s).cast("double"),
        "octets": octets(s, "[.:-]").cast("double"),
        "bounded": F.coalesce(F.col("after").rlike(r"^$|[\s.,;:!?)\]>]"), F.lit(False)).cast("double") + F.coalesce(F.col("before").rlike(r"^$|[\s(\[<:]$"), F.lit(False)).cast("double"),
        **{k: F.coalesce(v, F.lit(0)).cast("double") for k, v in telling().items()},
        "cued": F.coalesce(F.lower("before").rlike(CUES), F.lit(False)).cast("double"),
        **{f"is_{k}": (F.col("kind") == k).cast("double") for k in KINDS},
    }
    return candidates.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in columns.items()})


def _variants(kind: str) -> tuple[list[Column], list[Column]]:
    """(ways to write a base span of a kind so that only the generators see it, the same with its check broken)."""
    said = F.col("said")
    if kind == "email":
        swap = lambda at, dot: F.concat(F.substring_index(said, "@", 1), F.lit(at), F.replace(F.substring_index(said, "@", -1), F.lit("."), F.lit(dot)))
        good = [swap(" @ ", "."), swap(" [at] ", "."), swap("(at)", " [dot] "), swap(" [at] ", " (dot) ")]
        # no last label of an address consists of digits
        return good, [F.concat(F.regexp_replace(g, r"[A-Za-z0-9-]+$", ""), F.lit("42")) for g in good]
    if kind == "ip":
        good = [F.translate(said, ".", sign) for sign in ("-", ":")]
        return good, [F.regexp_replace(g, r"^[0-9]+", "712") for g in good]
    digits = F.regexp_replace(said, "[^0-9]", "")
    if kind == "card":
        good = [F.regexp_replace(digits, r"([0-9]{4})(?=[0-9])", f"$1{sign}") for sign in (".", "/")]
        return good, [F.concat(F.substring(g, 1, 18), F.translate(F.substring(g, 19, 99), "0123456789", "1234567890")) for g in good]
    groups = [F.regexp_replace(digits, r"^([0-9]{2,4}?)([0-9]{3,4})([0-9]{4})$", f"$1{sign}$2{sign}$3") for sign in (" ", "-", ".")]
    # groups of digits without any prefix may be anything, unless a word announces them
    cued = F.lower("before").rlike(CUES)
    return [F.concat(F.lit("00"), g) for g in groups] + [F.when(cued, g) for g in groups], [F.when(~cued, g) for g in groups]


def _fails(c: Column) -> Column:
    """True if a candidate's own format rules it out."""
    said, n = c["said"], digit_count(c["said"])
    return F.when(c["kind"] == "card", ~(n.between(16, 19) & luhn(said))).when(c["kind"] == "ip", ~octets(said, "[.:-]")).when(c["kind"] == "phone", ~n.between(8, 15)).otherwise(said.rlike("[0-9]$"))


def contexts(rows: DataFrame, n: int | None = None) -> DataFrame:
    """(how, slot, of, c_before, c_after): what stands before and after numbers that no pattern
    and no generator touches, at most CONTEXTS for each way ``how`` that they speak against
    personal data, numbered from 0 to ``of`` - 1, from all rows (text); their number ``n`` no
    longer matters. Neighbourhoods that tell nothing, such as plain words, or that
    announce personal data are no counter-examples."""
    touched = "|".join(f"(?:{p})" for k in KINDS for p in (BASE[k], BROAD[k]))
    some = rows.where(F.col("text").rlike("[0-9]"))
    found = some.select(F.explode(find(F.regexp_replace("text", touched, "\ufffc"), NUMBER, "number")).alias("c")).select("c.before", "c.after").where(~F.lower("before").rlike(CUES))
    ways = F.explode(F.filter(F.array(*[F.when(v > 0, F.lit(k)) for k, v in telling().items()]), lambda x: x.isNotNull()))
    place = F.pmod(F.xxhash64("before", "after"), F.lit(CONTEXTS)).cast("int").alias("place")
    # of a place's neighbourhoods the one with the least hash, so that copies don't matter
    least = F.min(F.struct(F.xxhash64("before", "after", F.lit(1)).alias("h"), "before", "after")).alias("x")
    held = found.withColumn("how", ways).groupBy("how", place).agg(least)
    # CONTEXTS rows a way at most
    each = Window.partitionBy("how")
    return held.select("how", (F.row_number().over(each.orderBy("place")) - 1).alias("slot"), F.count("*").over(each).alias("of"), F.col("x.before").alias("c_before"), F.col("x.after").alias("c_after"))


def examples(spotted: DataFrame, around: DataFrame) -> DataFrame:
    """(kind, said, before, after, label, draw) to learn from: rewritten base spans where they
    stood and in the contexts ``around`` of other numbers, and candidates of the
    corpus that clash with none and fail their check."""
    base = spotted.where(F.size("base") > 0).select("fp", F.explode("base").alias("c")).select("fp", "c.*")
    made = None
    for kind in KINDS:
        good, bad = _variants(kind)
        both = F.array(*[F.struct(x.alias("said"), F.lit(label).alias("label")) for label, xs in ((1, good), (0, bad)) for x in xs])
        rows = base.where(F.col("kind") == kind).select("fp", "kind", "start", "before", "after", F.explode(both).alias("x")).select("fp", "kind", "start", "before", "after", "x.*")
        rows = rows.where(F.col("said").rlike(f"^(?:{BROAD[kind]})$"))
        made = rows if made is None else made.union(rows)
    # the same strings in a neighbourhood of other numbers of each way; CONTEXTS a way bound the broadcast
    around = F.broadcast(keep(around, "pii-contexts"))
    ways = made.where("label = 1").withColumn("how", F.explode(F.array(*map(F.lit, telling())))).join(F.broadcast(around.groupBy("how").agg(F.first("of").alias("n"))), "how")
    slotted = ways.withColumn("slot", F.pmod(F.xxhash64("fp", "start", "said", "how"), F.col("n")).cast("int"))
    moved = slotted.join(around, ["how", "slot"]).select("fp", "kind", "start", F.col("c_before").alias("before"), F.col("c_after").alias("after"), "said", F.lit(0).alias("label"))
    made = made.unionByName(moved)
    open_ = F.filter("broad", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])) & _fails(c))
    own = spotted.where(F.size("broad") > 0).select("fp", F.explode(open_).alias("c")).select("fp", "c.kind", "c.start", "c.before", "c.after", "c.said", F.lit(0).alias("label"))
    return made.unionByName(own).withColumn("draw", F.pmod(F.xxhash64("fp", "start", "kind"), F.lit(1_000_000)))


def train(rows: DataFrame) -> tuple[GBTClassificationModel, dict[str, float]] | None:
    """The trees and each kind's threshold, from all examples; None unless both labels occur. Examples
    of the same features are one row that weighs as much as they do, and both labels
    weigh the same; rewritings of one span are all learned from or all held back."""
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not (counts.get(0) and counts.get(1)):
        return None
    held = F.pmod(F.xxhash64("draw"), F.lit(5)) == 0
    same = features(rows).withColumn("held", held).groupBy("kind", "label", "held", *FEATURES).agg(F.count("*").alias("n"))
    # the labels' weights add up to the same, the mean weight of an example being 1
    share = {label: (counts[0] + counts[1]) / 2 / counts[label] for label in (0, 1)}
    weight = F.col("n") * F.when(F.col("label") == 1, share[1]).otherwise(share[0])
    wide = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(same)
    wide = keep(wide.select("kind", "features", F.col("label").cast("double").alias("label"), "held", weight.alias("weight")), "pii-train")
    used = {r["label"] for r in wide.where(~F.col("held")).select("label").distinct().collect()}
    if len(used) < 2:
        return None
    model = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, seed=7, weightCol="weight").fit(wide.where(~F.col("held")))
    # bins of one percent: at most a hundred and one for each kind
    bins = model.transform(wide.where("held")).select("kind", F.floor(vector_to_array("probability")[1] * 100).cast("int").alias("bin"), "label", "weight").groupBy("kind", "bin").agg(F.sum("weight").alias("n"), F.sum(F.col("label") * F.col("weight")).alias("good")).orderBy("kind", F.col("bin").desc()).collect()
    thresholds = {}
    for kind in KINDS:
        n = good = 0.0
        thresholds[kind] = 2.0  # no score reaches it: nothing is added without evidence
        for r in (r for r in bins if r["kind"] == kind):
            n, good = n + r["n"], good + r["good"]
            if good < PRECISION * n:
                break
            thresholds[kind] = max(r["bin"] / 100, LEAST_SCORE)
    return model, thresholds


def _order(spans: Column) -> Column:
    """Spans as sorted (rank of kind, start, end) structs."""
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.struct(rank(s).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, fp, base, all: base spans and all spans of every row, as arrays of
    (k, start, end, kind); ``fp`` is the text's MD5. Null texts are empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    spotted = keep(rows.select("doc_id", F.md5("text").alias("fp"), base_spans(F.col("text")).alias("base"), broad_spans(F.col("text")).alias("broad")), "pii")
    clash = lambda c: F.exists("base", lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))
    around = contexts(rows.select("text"))
    trained = train(keep(examples(spotted, around), "pii-examples"))
    base = _order(F.col("base"))
    if trained is None:
        return spotted.select("doc_id", "fp", base.alias("base"), base.alias("all"))
    model, thresholds = trained
    threshold = F.coalesce(*[F.when(F.col("kind") == k, F.lit(x)) for k, x in thresholds.items()])
    each = spotted.where(F.size("broad") > 0).select("doc_id", "fp", F.explode(F.filter("broad", lambda c: ~clash(c))).alias("c")).select("doc_id", "fp", "c.*")
    open_ = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(each))
    added = model.transform(open_).where(vector_to_array("probability")[1] >= threshold).groupBy(F.col("doc_id").alias("id"), F.col("fp").alias("of")).agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    joined = spotted.select("doc_id", "fp", "base").join(added, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("fp") == F.col("of")), "left")
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select("doc_id", "fp", base.alias("base"), _order(F.concat(plain, F.coalesce("added", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")))).alias("all"))


def counted(spans: str, kind: str) -> Column:
    """How many of the spans are of a kind."""
    return F.size(F.filter(F.transform(spans, lambda s: s["kind"]), lambda k: k == kind)).cast("long").alias(f"n_{kind}")


def base_digest(spans: str) -> Column:
    """SHA-256 of kind:start:end of the spans by kind and start, comma-joined."""
    return F.sha2(_text(_order(F.col(spans))), 256).alias("base_sha256")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row for each row of ``docs``."""
    return find_personal_data(docs).select("doc_id", *[counted("base", k) for k in KINDS], base_digest("base"), _text(F.col("all")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of the text replaced by ``<KIND>``; overlapping spans go as one, named by the first."""
    spans = find_personal_data(docs).select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"), F.array_sort(F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("__spans")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        gap = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, F.concat(state["out"], gap, F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(state["out"]).alias("out"))

    joined = docs.join(spans, docs["doc_id"].eqNullSafe(spans["__id"]) & (F.md5(text) == spans["__fp"]), "left")
    clean = F.aggregate("__spans", start, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    return joined.withColumn("text", clean).select(*docs.columns)
