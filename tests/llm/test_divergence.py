"""Source divergences against plain loops with whole numbers of any size."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from humsearch.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def naive(rows, most=200):
    """rows (lang, source, text)"""
    count, docs = defaultdict(Counter), defaultdict(Counter)
    groups = sorted({(a or "", b or "") for a, b, _ in rows})
    for lang, source, text in rows:
        words = TERM.findall((text or "").translate(UPPER))
        count[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in {a for a, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        mine = [s for a, s in groups if a == lang]

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: shares(count[lang, s]) for s in mine}
        q = shares(sum((count[lang, s] for s in mine), Counter()))
        for s in mine:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in mine if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1) if part == "pair" or k <= most]
    return sorted(out)


def corpus(n, sources, seed=1):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)] + ["É", "ß", "Ünï", "日本", "x y", "Z"]
    made = []
    for _ in range(n):
        words = rng.choice(vocabulary, size=int(rng.integers(0, 40)), p=(w := 1 / np.arange(1, len(vocabulary) + 1)) / w.sum())
        made.append(("en" if rng.random() < 0.6 else "de", f"s{int(rng.integers(0, sources))}", " ".join(w.upper() if rng.random() < 0.3 else w for w in words)))
    return made


ODD = [(None, None, "one Two"), ("", None, "two three"), (None, "", "TWO"), ("fr", None, None), ("fr", "a", "x" * 60_000), ("fr", "b", "...123"), ("it", "only", "ciao ciao"), ("it", "only", "ciao"), ("it", "only", "CIAO [ciao] `ciao"), ("en", "s0", "@A{b}~ZÉé"), ("en", "s0", "@A{b}~ZÉé"), ("en", "s0", "@A{b}~ZÉé")]


def frame(spark, rows):
    # further columns named like those of the result
    return spark.createDataFrame([(k, *r, 1, "x", k) for k, r in enumerate(rows)], "value int, lang string, source string, text string, rank int, item string, count int")


@pytest.mark.parametrize("sizes", [{}, {"groups": 2, "chunk": 50}, {"groups": 1, "chunk": 7}])
def test_audit(spark, sizes):
    rows = corpus(250, 7) + ODD
    got = sorted(tuple(r) for r in divergence.audit(frame(spark, rows), **sizes).collect())
    assert got == naive(rows)
    # a language without kept terms has pairs of value 0
    assert ("fr", "", "pair", "a", 0, 1) in got and not [r for r in got if r[0] == "it" and r[2] == "pair"]


def test_ties_and_limits(spark):
    rows = [("en", s, f"{a}{b} {c}") for s, c in (("x", "u"), ("y", "v")) for a in "abcdefghijklmnop" for b in "abcdefghijklmnop" for _ in range(3)]
    got = sorted(tuple(r) for r in divergence.audit(frame(spark, rows), most_terms=5).collect())
    assert got == naive(rows, 5)
    same = [("en", s, "equal texts everywhere") for s in "abcd"]
    assert {r["value"] for r in divergence.audit(frame(spark, same)).collect()} == {0}
    assert divergence.audit(frame(spark, same).limit(0)).count() == 0


def test_shares_of_large_numbers(spark):
    numbers = [(1, 3), (9 * 10**14, 10**15), (123_456_789_012_345, 8 * 10**15), (1, 9 * 10**15), (7, 7)]
    want = [1 + 10**9 * k // d for k, d in numbers]
    got = spark.createDataFrame(numbers, "k long, d long").select(divergence.share(F.col("k"), F.col("d"))).collect()
    assert [r[0] for r in got] == want
    k, d = np.array(numbers).T
    assert divergence._shares(k, d).tolist() == want


def test_pieces_change_nothing(spark, monkeypatch):
    rows = corpus(120, 3, seed=2) + ODD
    monkeypatch.setattr(divergence, "PIECE_BYTES", 64)
    got = sorted(tuple(r) for r in divergence.audit(frame(spark, rows)).collect())
    assert got == naive(rows)
