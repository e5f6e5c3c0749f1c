"""Fill-in-middle: bitvectors and whole results against plain loops over code points."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from humsearch.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def naive(doc_id, text):
    text = text or ""
    sha = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(sha[8 * k : 8 * k + 8], 16) for k in range(4)]
    w = TOKEN.findall(text)
    a, b = sorted(x % (len(w) + 1) for x in h[:2])
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(w), "plain", None, None, text
    spm = h[3] % 100 < 80
    return len(w), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("n", [0, 1, 7, 8, 511, 512, 513, 5000])
@pytest.mark.parametrize("density", [0.0, 0.01, 0.5, 1.0])
def test_bit_vector(n, density):
    bits = np.random.default_rng(n).random(n) < density
    v = infill.BitVector(bits)
    assert v.total == bits.sum() and len(v) == n
    places = np.arange(n + 1)
    assert v.rank(places).tolist() == [int(bits[:k].sum()) for k in places]
    assert v.select(np.arange(v.total + 1)).tolist() == [*np.flatnonzero(bits).tolist(), n]
    with pytest.raises(IndexError):
        v.select(np.array([v.total + 1]))


TEXTS = [None, "", " ", "\n\n", "one", " one", "one ", "a  b\tc\r\nd ", "é 😀\x0b ü", "has <P> in it", "<S", "a< S> b <M c", "no\xa0break　space", "x" * 70_000, "w " * 40_000, "same text here", "same text here"]


def test_whole_results(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(k, t, "x", 1, "plain") for k, t in enumerate(TEXTS)] + [(15, "same text here", "x", 1, None), (None, "no id", None, None, None), (-5, "below zero", "x", 1, None)]
    rows += [(100 + k, "".join(rng.choice(list("ab <SMPé>\n\t"), size=int(rng.integers(0, 60)))), None, None, None) for k in range(600)]
    # columns with names of the result, in another order
    docs = spark.createDataFrame([(r[2], r[1], r[0], r[3], r[4]) for r in rows], "output string, text string, doc_id long, n int, form string")
    made = infill.infill(docs)
    got = sorted((tuple(r) for r in made.collect()), key=repr)
    assert got == sorted(((r[0], *naive(r[0], r[1])) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    told = infill.digest(made).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(((r["doc_id"], r["restored_sha256"]) for r in told), key=repr) == sorted(((r[0], sha(r[1] or "")) for r in rows), key=repr)
    assert sorted(r["output_sha256"] for r in told) == sorted(sha(naive(r[0], r[1])[-1]) for r in rows)
    assert infill.infill(docs.limit(0)).count() == 0
    # always and suffix never first
    all_psm = infill.infill(docs, rate=100, suffix_first=0).select(F.col("form")).distinct().collect()
    assert {r[0] for r in all_psm} == {"plain", "psm"}


def test_pieces_change_nothing(monkeypatch):
    texts, draws = pa.array([t or "" for t in TEXTS]), np.random.default_rng(1).integers(0, 2**32, (len(TEXTS), 4))
    whole = [c.to_pylist() for c in infill._rearranged(texts, draws, 50, 80)]
    for size in (1, 10, 1000):
        parts = [infill._rearranged(t, draws[at : at + len(t)], 50, 80) for at, t in infill._pieces(texts, size)]
        assert [sum((p[k].to_pylist() for p in parts), []) for k in range(5)] == whole
