"""The corpus operators against brute force, on edge cases and small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from humsearch.llm import ann, chat, decontaminate, mixing, pii, probminhash, quality, tokens, toxicity, urls
from humsearch.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, size int, fp string"
LONG = " ".join(f"w{k}" for k in range(30_000))
TEXTS = [None, "", "   ", "one", "a b c d e f g", "a b c d e f g", LONG, "İstanbul é́ 😀 </s>", "x" * 50_000, "mail a@b.co or +1 (234) 555-0000"]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns with clashing names."""
    rows = [(k, t, "en", f"s{k % 2}", len(t or ""), "x", 3, "y") for k, t in enumerate(TEXTS)] + [(None, "nobody", None, None, None, None, None, None), (4, TEXTS[4], "en", "s0", 1, "x", 3, "y")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 3 == 0 and 1 or 0) for k in range(10)] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def test_chat_digest(spark):
    own = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a\\ <s>\\"), (1, 1, "assistant", "a\\ <s>\\"), (2, 0, None, own), (None, 5, "assistant", "[INST[INST]]"), (-1, 1, "assistant", own), (-1, 0, "user", own)] + [(3, k, "assistant", f"t{k}" * k) for k in range(60)]
    got = {r["conv_id"]: r for r in chat.digest(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for conv, r in got.items():
        mine = sorted((x[1:] for x in rows if x[0] == conv), key=lambda x: (x[0], x[1] or "", x[2] or ""))
        turns = [(role or "", text or "") for _, role, text in mine]
        said = "".join(t for role, t in turns if role == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and r["loss_chars"] == len(said)
        assert r["formatted_chars"] == len(chat.instruct_template(turns)) and r["n_turns"] == len(turns)
    assert set(got) == {1, 2, 3, None, -1}


@pytest.mark.parametrize("text", ["", "\\", "<s></s>", "[INST][/INST]", "<\\/s>", "[[/INST]", "</", "\\</s>\\"])
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat._CONTROLS)
    assert chat.parse_turns(chat.instruct_template([(text, text)] * 2)) == [(text, text)] * 2


def test_rewriting_template_is_found(spark):
    rows = spark.createDataFrame([(1, k, "user", f"t{k}") for k in range(4)], "conv_id long, turn long, role string, text string")
    hides = chat.Template(lambda turns: "".join("(old)" if k < len(turns) - 2 else f"<{t}>" for k, (_, t) in enumerate(turns)))
    assert chat.format_turns(rows, hides).where("rewritten").count() == 2
    assert chat.formatted_conversations(rows).count() == 1
    # says that it looks at no other turn, but its span tells how many there were
    lies = chat.Template(lambda turns: "".join(f"<{min(k, 20)}:{t}>" for k, (_, t) in enumerate(turns)), 0)
    longer = spark.createDataFrame([(1, k, "user", f"t{k}") for k in range(40)], "conv_id long, turn long, role string, text string")
    assert chat.format_turns(longer.coalesce(1), lies).where("rewritten").count() >= 1
    assert chat.digest(chat.format_turns(rows.limit(0))).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.standard_normal(16).astype(np.float32)]) for k in range(3000)]
    rows += [(5000 + k, rows[100][1]) for k in range(40)]
    rows += [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] * 16), (9300, [None] * 16), (None, rows[0][1]), (9400, [1.0, 2.0]), (9500, []), rows[7]]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    fine = [(i, v) for i, v in dict((i, v) for i, v in rows if i is not None).items() if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    ids, x = np.array([i for i, _ in fine]), np.array([v for _, v in fine])
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]]
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 10 and mine["rank"].tolist() == list(range(1, 11))
        hits += len(set(want) & set(mine.vec_id))
        total += 10
    assert hits / total >= 0.9
    hot = got[got.query_id == 100].sort_values("rank")
    assert hot.vec_id.tolist() == list(range(5000, 5010)) and (hot.score == 0).all()
    assert not (set(got.query_id) & {9000, 9100, 9200, 9300})
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_of_ties_and_doubled_ids(spark):
    # a grid: many different vectors at one distance; ids with two vectors; clashing columns
    grid = [(i, [1.0 + i // 20, 1.0 + i % 20]) for i in range(400)]
    rows = [(1000 + (i * 7) % 400, v, 1, 2) for i, v in grid] + [(200, [3.0, 4.0], 1, 2), (200, [18.0, 4.0], 1, 2), (1100, [2.5, 2.5], 1, 2)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, class_id int, rank int"), shards=3).collect()
    want = []
    for q, v, *_ in rows:
        if q % 100 == 0:
            near = sorted((((v[0] - w[0]) ** 2 + (v[1] - w[1]) ** 2) ** 0.5, i) for i, w, *_ in rows if (i, w) != (q, v))
            want += [(q, k + 1, i, d) for k, (d, i) in enumerate(near[:10])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def test_shards_follow_from_the_table_alone():
    assert [ann.shard_count(n) for n in (0, 1, 4_096, 4_097, 51_282, 10**6, 32 * 10**6, 10**9)] == [1, 1, 1, 2, 13, 64, 64, 2_000]
    assert max(n / ann.shard_count(n) for n in range(1, 5 * 10**7, 99_991)) <= ann.MOST_ROWS


def test_graph_of_clusters_is_found_whole():
    rng = np.random.default_rng(2)
    x = np.concatenate([c + 0.01 * rng.standard_normal((150, 24)) for c in rng.standard_normal((40, 24))])
    layers = ann.build_graph(x, 3)
    q = x[::50]
    ids, dist = ann.search_graph(x, layers, q, 10)
    exact = np.argsort(((q[:, None] - x[None]) ** 2).sum(2), axis=1, kind="stable")[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(ids.tolist(), exact.tolist(), strict=True)]) >= 9.5
    assert (np.diff(dist, axis=1) >= 0).all()
    for nodes, flat in layers:
        # links are rows of the layer, no row has itself
        assert set(flat[flat >= 0]) <= set(nodes.tolist()) and (flat != nodes[:, None]).all()


def test_quality(spark, sf_dir, docs, labels):
    d, known = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    got = quality.score_documents(d, known).join(known, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() >= 0.95
    edge = quality.score_documents(docs, labels).toPandas()
    assert len(edge) == docs.count() and edge.score.between(0, 1).all()
    assert quality.score_documents(docs.limit(0), labels).count() == 0
    assert (quality.score_documents(docs, labels.limit(0)).toPandas().score == 0.5).all()
    assert quality.filter_documents(docs, labels.limit(0)).columns == docs.columns


def test_discriminant_equals_densities(spark):
    """Scores are those of two Gaussian densities with shrunken covariances, computed plainly."""
    rng = np.random.default_rng(13)
    texts = [" ".join(rng.choice(["aa", "bb", "CC!", "d9", "e|", "ff"], int(rng.integers(0, 40)))) for _ in range(300)]
    known = [(k, int(t.count("!") * 3 < len(t.split())) if rng.random() < 0.9 else int(rng.integers(0, 2)), 0) for k, t in enumerate(texts) if k % 3]
    d, y = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(d, y).collect()}
    x = np.array([quality.statistics(t) for t in texts])
    used = [(k, q) for k, q, _ in known if zlib.crc32(str(k).encode()) % 5]
    of = [x[[k for k, q in used if q == c]] for c in (0, 1)]
    cov = [np.cov(v.T, bias=True) for v in of]
    pooled = np.diag(sum(len(v) * np.diag(c) for v, c in zip(of, cov, strict=True)) / len(used))
    cov = [0.9 * c + 0.1 * pooled + 1e-3 * np.eye(len(c)) for c in cov]
    log = [-0.5 * (np.einsum("ij,jk,ik->i", x - v.mean(0), np.linalg.inv(c), x - v.mean(0)) + np.linalg.slogdet(c)[1]) for v, c in zip(of, cov, strict=True)]
    want = 1 / (1 + np.exp(-np.clip(log[1] - log[0] + np.log((len(of[1]) + 1) / (len(of[0]) + 1)), -60, 60)))
    assert [got[k] for k in range(300)] == pytest.approx(want.tolist(), abs=1e-6)


def test_urls(spark):
    cases = {None: ("", "", None), "no": ("", "", None), "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/"), "x://net": ("net", "", None), "x://net/": ("net", "/", "net/"), "x://bnet/": ("bnet", "/", None), "a://b://c.net/": ("b:", "//c.net/", None), "h://example.com/de/": ("example.com", "/de/", "example.com/de/"), "h://é.org/fr/#": ("é.org", "/fr/", "org/fr/"), "h://x.net?a://y": ("x.net", "", None), "": ("", "", None)}
    rows = spark.createDataFrame([(k, u, 1) for k, u in enumerate(cases)] + [(0, None, 2), (None, "h://q.net/", 3)], "page_id long, url string, items int")
    got = urls.judge(rows).collect()
    assert len(got) == len(cases) + 2
    for r in got:
        if r["page_id"] is not None:
            assert (r["host"], r["path"], r["rule"]) == cases[list(cases)[r["page_id"]]]
        assert r["verdict"] in ("allow", "block")
    assert urls.judge(rows.limit(0)).count() == 0


def test_mined_rules(spark):
    items = [(["a=1", "b=1"], "block")] * 30 + [(["a=1", "b=2"], "allow")] * 30 + [(["c=1"], "allow")] * 5
    rules = urls.mine(spark.createDataFrame(items, "items array<string>, verdict string"))
    got = {(tuple(r["items"]), r["verdict"]): r for r in rules.collect()}
    assert got[("b=1",), "block"]["confidence"] == 1 and got[("b=2",), "allow"]["confidence"] == 1
    assert (("a=1", "b=1"), "block") not in got
    best = urls.match(spark.createDataFrame([(["a=1", "b=1"],), (["z=1"],)], "items array<string>"), rules).collect()
    assert [(r["mined_verdict"], r["mined_rule"]) for r in best] == [("block", "b=1")]


def brute_rules(rows, support, confidence):
    """Rules of all item sets, without those that a rule of a proper subset equals or beats."""
    rules = {}
    for s in {c for items, _ in rows for n in range(1, len(items) + 1) for c in combinations(sorted(items), n)}:
        of = [v for items, v in rows if set(s) <= set(items)]
        for v in set(of):
            n = of.count(v)
            if n >= support * len(rows) and n >= confidence * len(of):
                rules[s, v] = n / len(of)
    sure = {}
    for (s, _), c in rules.items():
        sure[s] = max(c, sure.get(s, 0))
    return {(s, v): c for (s, v), c in rules.items() if not any(sure.get(t, -1) >= c for n in range(1, len(s)) for t in combinations(s, n))}


def test_rules_equal_all_item_sets(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(240):
        items = sorted(x for x in "abcdef" if rng.random() < 0.5) or ["a"]
        rows.append(([f"{x}=1" for x in items], "block" if ("b" in items and "c" in items) or rng.random() < 0.2 else "allow"))
    rows += [(["g=1", "h=1", "i=1"], "block")] * 20 + [(["g=1", "i=1"], "allow")] * 20
    got = {(tuple(r["items"]), r["verdict"]): r["confidence"] for r in urls.mine(spark.createDataFrame(rows, "items array<string>, verdict string"), 0.02, 0.6).collect()}
    assert got == pytest.approx(brute_rules(rows, 0.02, 0.6))


def test_long_rules_are_pruned_by_size(spark):
    # sixteen items, three of them left out of each row: sets of several items occur often
    rng = np.random.default_rng(8)
    names = [f"{x}=1" for x in "abcdefghijklmnop"]
    rows = [([x for x in names if x not in set(rng.choice(names, 3, replace=False))], "block" if rng.random() < 0.7 else "allow") for _ in range(60)]
    table = spark.createDataFrame(rows, "items array<string>, verdict string")
    got = {(tuple(r["items"]), r["verdict"]): r["confidence"] for r in urls.mine(table, 0.3, 0.6).collect()}
    held = {}
    for items, v in rows:
        for n in range(1, 8):
            for c in combinations(items, n):
                held.setdefault(c, Counter())[v] += 1
    least = 0.3 * len(rows)
    assert not any(n >= least for c, of in held.items() if len(c) == 7 for n in of.values())
    rules = {(c, v): n / of.total() for c, of in held.items() for v, n in of.items() if n >= least and n >= 0.6 * of.total()}
    sure = {}
    for (c, _), x in rules.items():
        sure[c] = max(x, sure.get(c, 0))
    want = {k: x for k, x in rules.items() if not any(sure.get(t, -1) >= x for n in range(1, len(k[0])) for t in combinations(k[0], n))}
    assert got == pytest.approx(want) and max(len(c) for c, _ in got) > 2


def test_matching_rules(spark):
    rng = np.random.default_rng(4)
    sets = [sorted(x for x in "abcdefg" if rng.random() < 0.6) for _ in range(60)]
    rules = [(k, sorted(x for x in "abcdefgz" if rng.random() < 0.4) or ["a"], "block" if k % 2 else "allow", float(rng.integers(6, 10)) / 10, float(rng.integers(1, 4)) / 10) for k in range(25)]
    table = spark.createDataFrame([(k, i, len(i), v, c, s) for k, i, v, c, s in rules], "rule_id long, items array<string>, size int, verdict string, confidence double, support double")
    distinct = [list(x) for x in {tuple(s) for s in sets if s}]
    got = {tuple(r["items"]): (r["mined_verdict"], r["mined_rule"]) for r in urls.match(spark.createDataFrame([(s,) for s in distinct], "items array<string>"), table).collect()}
    want = {}
    for s in distinct:
        fits = [(-c, -p, -len(i), " ".join(i), v) for _, i, v, c, p in rules if set(i) <= set(s)]
        if fits:
            want[tuple(s)] = (min(fits)[4], min(fits)[3])
    assert got == want


def test_every_label_part_and_key_is_a_token(spark):
    rows = spark.createDataFrame([("x://www.Casino.example.com/en/a7/slots.html?ref=1&bet=2&ref#t",)], "url string")
    host, path = urls.host_and_path(F.col("url"))
    got = rows.select(urls.tokens(F.col("url"), host, path)).first()[0]
    assert {"label=www", "label=casino", "label=example", "label=com", "part=en", "part=a#", "part=slots.html", "key=ref", "key=bet", "ext=html", "first=www", "fragment=yes"} <= set(got)
    assert got == sorted(set(got))
    # the only tokens that tell the verdict are a middle label, a later part and a later key
    of = {"net": ("pills", "buy", "bet"), "com": ("books", "read", "page")}
    urls_ = [f"h://w.{of[t][0]}.example.{t}/{k % 2}/{of[t][1]}?a=1&{of[t][2]}=2" for t in of for k in range(30)]
    pages = spark.createDataFrame(enumerate([*urls_, "h://w.pills.example.org/", "h://w.x.example.org/1/buy", "h://w.x.example.org/1?a=1&bet=3"]), "page_id long, url string")
    said = {r["page_id"]: r["verdict"] for r in urls.judge(pages, (("net/", "block"), ("com/", "allow"))).collect()}
    assert [said[k] for k in (60, 61, 62)] == ["block"] * 3


def test_rules_name_every_token_of_the_same_urls(spark):
    items = [(["a=1", "b=1", "c=1"], "block")] * 30 + [(["c=1"], "allow")] * 30
    got = {(tuple(r["items"]), r["verdict"]) for r in urls.mine(spark.createDataFrame(items, "items array<string>, verdict string")).collect()}
    assert got == {(("a=1",), "block"), (("b=1",), "block")}


def test_toxicity(spark, docs, labels):
    rng = np.random.default_rng(4)
    words = [f"word{k}" for k in range(300)]
    bad = ["zorgle", "blatnik", "quaxing"]
    rows, known = [], []
    for k in range(900):
        toxic = k % 5 == 0
        text = list(rng.choice(words, 40)) + (list(rng.choice(bad, 3)) if toxic else [])
        rows.append((k, " ".join(rng.permutation(text))))
        known.append((k, 1, int(toxic)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(d, y).join(y, "doc_id").where("held_out").toPandas()
    assert len(got) > 100 and (got.predicted == got.toxic).mean() >= 0.97
    edge = toxicity.score_documents(docs, labels).toPandas()
    assert len(edge) == docs.count() and edge.score.between(0, 1).all()
    assert len(toxicity.score_documents(docs, labels.limit(0)).toPandas()) == docs.count()
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_label_model_finds_rates_and_dependences():
    rng = np.random.default_rng(7)
    n, rates = 60_000, np.array([[0.02, 0.02, 0.05, 0.1, 0.3], [0.7, 0.6, 0.5, 0.4, 0.3]])
    truth = (rng.random(n) < 0.1).astype(int)
    votes = (rng.random((n, 5)) < rates[truth]).astype(int)
    # the sixth repeats the first nine times in ten: together they are worth hardly more than one
    copies = np.where(rng.random(n) < 0.9, votes[:, 0], rng.random(n) < 0.1)
    votes = np.column_stack([votes, copies])
    bits = (votes << np.arange(6)).sum(1)
    known = rng.random(n) < 0.2
    counts = Counter((int(b), int(t) if k else None) for b, t, k in zip(bits, truth, known, strict=True))
    model = toxicity.label_model(counts, 0.1, n_voters=6, leading=2)
    assert model.share[1] == pytest.approx(0.1, abs=0.02)
    assert all(model.parent[c][5] == 0 or model.parent[c][0] == 5 for c in (0, 1))
    every = (np.arange(64)[:, None] >> np.arange(6)) & 1
    want = np.array([[truth[bits == b].sum(), (bits == b).sum()] for b in range(64)])
    often = want[:, 1] >= 300
    assert np.abs(model.posterior(every.astype(float)) - want[:, 0] / np.maximum(want[:, 1], 1))[often].max() < 0.06
    assert toxicity.label_model({(0, None): 5}, 0.1).posterior(np.zeros((1, len(toxicity.VOTERS))))[0] < 0.5


def plain_read(text, found):
    """Votes and buckets of one text, word by word."""
    words = (text or "").split()
    bit, plain = toxicity._BIT, lambda w: w.lower().strip(toxicity._MARKS)
    bits, held = 0, [k for k, w in enumerate(words) if found[w] & toxicity._LEXICAL]
    for w in words:
        bits |= found[w] & ((1 << len(toxicity.VOTERS)) - 1)
    if not words:
        return 0, []
    loud = [w for w in words if len(w) > 1 and w.isupper()]
    yours = [w for w in words if plain(w) in toxicity.SECOND]
    bits |= bit["two_entries"] * (len({plain(words[k]) for k in held}) >= 2) | bit["dense"] * (bool(held) and 50 * len(held) >= len(words))
    bits |= bit["shouted_entry"] * any(words[k].isupper() or "!" in words[k] for k in held)
    bits |= bit["entry_near_you"] * any(plain(w) in toxicity.SECOND for k in held for w in words[max(0, k - 3) : k + 4])
    bits |= bit["exclaiming"] * ("!" in text and 50 * text.count("!") >= len(words)) | bit["shouting"] * (bool(loud) and 10 * len(loud) >= len(words))
    bits |= bit["address"] * (bool(yours) and 20 * len(yours) >= len(words))
    return bits, sorted({b for k in held for b in found.entries[words[k]][1]})


def test_votes():
    found = toxicity._Found({"word=zorgle": True, "start4=quax": False, "word=dull": False})
    read = lambda texts: [x for part in toxicity.read(pa.array(texts, pa.string()), found) for x in zip(*part, strict=True)]
    voted = lambda text: {v for v in toxicity.VOTERS if read([text])[0][0] & toxicity._BIT[v]}
    assert voted(None) == voted("") == voted("plain words") == set()
    assert voted("plain " * 100 + "Zorgle,") == {"word"}
    assert voted("plain " * 200 + "you ZORGLE quaxing") == {"word", "start4", "two_entries", "shouted_entry", "entry_near_you"}
    assert voted("dull " + "plain " * 100) == {"fair_word"}
    assert voted("soooo what") == {"drawn_out"} and voted("an i**ot here") == {"masked"}
    rng = np.random.default_rng(15)
    texts = [None, "", " "] + [" ".join(rng.choice(["you", "Zorgle", "quaxed!", "dull", "IDIOT", "x", "yyy", "f*x", "word", "TO!"], int(rng.integers(0, 30)))) for _ in range(200)]
    assert [(int(b), k) for b, k in read(texts)] == [plain_read(t, found) for t in texts]
    assert voted("WHAT now") == {"shouting"} and voted("now!") == {"exclaiming"} and voted("you there") == {"address"}


def test_leaks(spark, docs):
    rng = np.random.default_rng(6)
    words = [f"t{k}" for k in range(4000)]
    items = [(k, " ".join(rng.choice(words, n)).capitalize() + ".") for k, n in enumerate([15, 38, 59, 120] * 5)]
    clean = [" ".join(rng.choice(words, 200)) for _ in range(60)]
    rows, want = [(k, t) for k, t in enumerate(clean)], set()
    for k, (item, text) in enumerate(items):
        rows.append((100 + k, f"{clean[k]} {text} {clean[-k - 1]}"))
        want.add((100 + k, item))
        part = text.split()
        kept = [w for j, w in enumerate(part) if j % 7 or j > len(part) - 8]
        rows.append((200 + k, f"{clean[k]} {' '.join(kept)} {clean[-k - 1]}"))
        want.add((200 + k, item))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([*items, (99, None), (98, " "), (None, "x y z")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(d, b).collect()} == want
    assert decontaminate.drop_leaks(d, b).count() == 60
    assert decontaminate.find_leaks(docs, b).count() == 0 and decontaminate.find_leaks(docs, b.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), b).count() == 0
    assert decontaminate.drop_leaks(docs, b).columns == docs.columns


def test_leaks_of_full_blocks_and_short_items(spark):
    rng = np.random.default_rng(11)
    words = np.array([f"t{k}" for k in range(3000)])
    share = 1 / np.arange(1, 3001)
    text = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    short = [(k, " ".join(rng.choice(words, int(rng.integers(8, 13)), replace=False))) for k in range(40)]
    items = short + [(k, text(int(rng.integers(15, 60)))) for k in range(40, 500)]
    clean = [text(400) for _ in range(40)]
    rows, must = list(enumerate(clean)), set()
    # short items back to back, and each item of the full block in a long document
    rows.append((1000, " ".join(t for _, t in short)))
    must |= {(1000, k) for k, _ in short}
    for k, t in items[::5]:
        rows.append((2000 + k, f"{clean[k % 40]} {t} {clean[(k + 1) % 40]}"))
        must.add((2000 + k, k))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(d, b).collect()}
    assert must <= got
    for m in (m for g in decontaminate.groups(d, b) for m in g.models):
        # candidates are exact: the latent products are those of the weighted words
        counts = np.array([np.bincount(p, minlength=len(m.idf)) * m.idf for p in m.passages])
        latent = m.latent * m.norm[:, None]
        assert np.allclose(latent @ latent.T, counts @ counts.T, rtol=1e-3, atol=1e-2)


def test_leaks_equal_brute_force_for_any_block(spark):
    rng = np.random.default_rng(12)
    words = np.array([f"t{k}" for k in range(400)])
    share = 1 / np.arange(1, 401)
    text = lambda n: list(rng.choice(words, n, p=share / share.sum()))
    items = [(k, " ".join(text(int(rng.integers(6, 90))))) for k in range(30)]
    rows = []
    for k in range(26):
        inner = items[k % 30][1].split()
        kept = [w for w in inner if rng.random() > (k % 5) / 10]
        rows.append((k, " ".join(text(int(rng.integers(0, 80))) + kept + text(30))))
    cut = [(i, *p) for i, t in items for p in decontaminate._cut(t, None)]
    uses, n = Counter(w for _, p, _ in cut for w in set(p)), len(cut)
    usual = {w for w, c in uses.items() if c > max(3, decontaminate.COMMON * n)}
    usual -= {w for _, p, _ in cut if set(p) <= usual for w in p}
    held = Counter(w for _, t in rows for w in set(t.split()))
    weight = lambda w: 0.0 if w in usual else (np.log((len(rows) + 1) / (held[w] + 1)) + 0.05) ** 2
    want = set()
    for d, t in rows:
        w = t.split()
        starts = [s for s in range(0, len(w), decontaminate.STRIDE) if s == 0 or s + decontaminate.WINDOW - decontaminate.STRIDE < len(w)]
        for window in (w[s : s + decontaminate.WINDOW] for s in starts):
            for i, p, answer in cut:
                best = np.zeros((len(window) + 1, len(p) + 1))
                for a, b in np.ndindex(len(window), len(p)):
                    best[a + 1, b + 1] = max(best[a, b + 1], best[a + 1, b], best[a, b] + weight(p[b]) * (window[a] == p[b]))
                common = best[-1, -1] / sum(map(weight, p))
                said = any(window[a : a + len(answer)] == answer for a in range(len(window)))
                if common >= decontaminate.WHOLE or (common >= decontaminate.PARAPHRASE and said):
                    want.add((d, i))
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for sizes in ((205, 8192), (7, 8192), (12, 20)):
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(d, b, *sizes).collect()} == want


def test_common_weight():
    rng = np.random.default_rng(2)
    idf = np.ones(6)
    for _ in range(20):
        a, b = rng.integers(0, 6, 12), rng.integers(0, 6, 9)
        d = np.zeros((13, 10))
        for i in range(12):
            for j in range(9):
                d[i + 1, j + 1] = max(d[i, j + 1], d[i + 1, j], d[i, j] + (a[i] == b[j]))
        assert decontaminate.common_weight(a, b, idf) == d[-1, -1]


def fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w, target, left, live = {s: weights[k % 3] for k, s in enumerate(order)}, {}, float(sum(sizes.values())), set(sizes)
    while live:
        share = {s: left * w[s] / sum(w[x] for x in live) for s in live}
        over = {s for s in live if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        live -= over
    return target


def test_mixing(spark, docs):
    rng = np.random.default_rng(9)
    rows = [(k, "w " * int(rng.integers(0, 60)), f"s{min(6, int(rng.exponential(2)))}" if k % 50 else None) for k in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, again = (mixing.mix_report(d).toPandas().sort_values("doc_id").reset_index(drop=True) for _ in range(2))
    assert got.equals(again) and len(got) == 3000
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = fill(sizes)
    got["source"] = [s for _, _, s in rows]
    for s, g in got.groupby("source", dropna=False):
        s = None if s != s else s
        assert g.target.iloc[0] == pytest.approx(want[s]) and g.source_size.iloc[0] == sizes[s]
        assert abs(g.taken.sum() - want[s]) <= g["size"].max()
    assert (got.taken <= 3 * got["size"]).all() and (got["size"] == [len(t.split()) for _, t, _ in rows]).all()
    edge = mixing.mix_report(docs).toPandas()
    assert len(edge) == docs.count()
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.mix_report(docs.limit(0)).count() == 0
    empty = mixing.mix_report(docs.where("text is null or text = ''")).toPandas()
    assert (empty.taken == 0).all()


def test_mixed_rows_are_the_taken_ones(spark):
    rng = np.random.default_rng(14)
    rows = [(k, "w " * int(rng.integers(0, 30)), f"s{k % 4}", k % 7) for k in range(400)] + [(5, "same text here", "s1", 0)] * 60
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    taken = mixing.mix_report(d).groupBy("doc_id").agg(F.sum("taken").alias("taken")).collect()
    mixed = mixing.mix_documents(d)
    assert mixed.columns == d.columns
    words, known = Counter(), {tuple(r) for r in rows}
    for r in mixed.collect():
        assert tuple(r) in known
        words[r["doc_id"]] += len(r["text"].split())
    assert {r["doc_id"]: r["taken"] for r in taken if r["taken"]} == {k: v for k, v in words.items() if v}


def test_mixing_of_repeated_rows(spark):
    rows = [(-1, "w " * 20, "a", 5)] * 1000 + [(k, "w " * 20, "a", 5) for k in range(2000)] + [(9000 + k, "v " * 20, "b", 5) for k in range(700)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    sizes = {"a": 60_000, "b": 14_000}
    got = mixing.mix_report(d).toPandas()
    assert len(got) == 3700
    for s, g in (("a", got[got.source_size == sizes["a"]]), ("b", got[got.source_size == sizes["b"]])):
        assert abs(g.taken.sum() - fill(sizes)[s]) <= 20
    share = fill(sizes)["a"] / sizes["a"]
    same = got[got.doc_id == -1].copies
    assert len(same) == 1000 and set(same) <= {int(share), int(share) + 1} and abs(same.sum() - 1000 * share) <= 1
    mixed, again = (Counter(map(tuple, mixing.mix_documents(d).collect())) for _ in range(2))
    want = got.groupby("doc_id").copies.sum()
    assert mixed == again and {r[0]: n for r, n in mixed.items()} == {int(k): int(n) for k, n in want.items() if n}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(text):
    d = [int(c) for c in text if c.isdigit()][::-1]
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            n = sum(c.isdigit() for c in m[0])
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 16 <= n <= 19 and luhn(m[0])) or (kind == "phone" and 8 <= n <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data(spark, docs):
    odd = ["a@b.c_x@d.e foo@bar..x@y.z @ a@-.b 1.2.3.4.5.6.7.8 300.1.2.3.4.5 1.2.3.4", "4111 1111 1111 1111  5 4111-1111-1111-1111 41111111111111111111111", "é😀 a@b.co +1 (234) 555-0000 +12 3 +1--------2345678", "0000255.1.1.1 1.1.1.999", "٤@b.c ١.١.١.١", "x" * 20_000 + "@" + "y." * 5_000 + "z " + "1" * 20_000]
    rng = np.random.default_rng(0)
    odd += ["".join(rng.choice(list("ab1.@ -+()4é"), 80)) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").unionByName(docs.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    got = pii.report(rows).collect()
    assert len(got) == rows.count()
    for r in got:
        want = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r["spans"].split(",")) | {""}
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert out[9] == "mail <EMAIL> or <PHONE>" and out[8] == TEXTS[8]
    assert pii.redact(docs).columns == docs.columns and pii.report(docs.limit(0)).count() == 0


def luhn_number(rng, n=16):
    digits = [int(d) for d in rng.integers(0, 10, n - 1)]
    twice = [2 * d - 9 * (d > 4) if k % 2 == 0 else d for k, d in enumerate(reversed(digits))]
    return "".join(map(str, [*digits, -sum(twice) % 10]))


def test_added_spans_come_from_the_trees(spark):
    """Addresses and numbers in other writing are added, others of the same shape are not."""
    rng = np.random.default_rng(8)
    name = lambda: "".join(rng.choice(list("abcdefgh"), int(rng.integers(3, 9))))
    rows = []
    for k in range(400):
        quad = ".".join(str(x) for x in rng.integers(0, 256, 4))
        said = [f"{name()}.{name()}@{name()}.org", quad, luhn_number(rng), f"+{rng.integers(10, 99)} {rng.integers(200, 999)} {rng.integers(1000, 9999)}"][k % 4]
        rows.append((k, f"words {name()} before {said} and {name()} after"))
    dotted = lambda s, sign: sign.join(s[i : i + 4] for i in range(0, len(s), 4))
    good, card = ["bob [at] example [dot] org", "carol.x @ home.net", "10-20-30-40", "192:168:0:17"], luhn_number(rng)
    good += [dotted(card, "."), dotted(luhn_number(rng), "/")]
    wrong = card[:-1] + str((int(card[-1]) + 1) % 10)
    bad = ["901-20-30-40", "1:2:3:444", dotted(wrong, "."), dotted(wrong, "/"), "5 @ 2.50"]
    rows += [(1000 + k, f"words x before {t} and y after") for k, t in enumerate(good)] + [(2000 + k, f"words x before {t} and y after") for k, t in enumerate(bad)]
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in enumerate(good):
        assert any(s.split(":")[1:] == ["15", str(15 + len(t))] for s in got[1000 + k].split(",")), t
    for k, t in enumerate(bad):
        assert got[2000 + k] == "", t


def test_only_the_context_tells_equal_strings_apart(spark):
    rng = np.random.default_rng(21)
    name = lambda: "".join(rng.choice(list("abcdefgh"), int(rng.integers(3, 9))))
    group = lambda n: str(rng.integers(10 ** (n - 1), 10**n))
    rows = []
    for k in range(600):
        phone = f"+{group(2)} {group(3)} {group(4)}"
        said = ["at " + ".".join(str(x) for x in rng.integers(0, 256, 4)), "of " + luhn_number(rng), f"call {phone}", f"with {phone}"][k % 4]
        other = [f"version {k % 9}.{k % 7}", f"order #{group(5)}", f'= "{group(6)}"', f"costs ${group(3)}", f"x{group(4)}y", f"{group(2)} things"][k % 6]
        rows.append((k, f"words {name()} before {said} and {name()} after, {other}, then"))
    card = luhn_number(rng)
    dotted = ".".join(card[i : i + 4] for i in range(0, 16, 4))
    told = {"10-20-30-40": ("host at {} and", "release version {} and"), dotted: ("paid with {} and", "order #{} and"), "555-123-4567": ("please call {} and", "words of {} and")}
    for k, (said, (yes, no)) in enumerate(told.items()):
        rows += [(1000 + k, yes.format(said)), (2000 + k, no.format(said))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.report(table).collect()}
    for k, (said, (yes, _)) in enumerate(told.items()):
        at = yes.index("{")
        assert any(s.split(":")[1:] == [str(at), str(at + len(said))] for s in got[1000 + k].split(",")), said
        assert got[2000 + k] == "", said
    text = F.col("text")
    spotted = table.select(F.md5(text).alias("fp"), pii.base_spans(text).alias("base"), pii.broad_spans(text).alias("broad"))
    around = pii.contexts(table.select("text"), 600)
    found = around.groupBy("how").agg(F.count("*").alias("n"), F.max("of").alias("of"), F.max("slot").alias("last")).collect()
    assert {r["how"] for r in found} == {"joined", "marked", "numbered"} and all(r["n"] == r["of"] == r["last"] + 1 for r in found)
    assert around.where("c_after = ' '").count() == 0  # numbers among plain words tell nothing
    model, thresholds = pii.train(pii.examples(spotted, around))
    weight = dict(zip(pii.FEATURES, model.featureImportances.toArray(), strict=True))
    assert weight["cued"] > 0 and sum(weight[k] for k in ("bounded", "joined", "marked", "numbered")) > 0.05
    assert set(thresholds) == set(pii.KINDS) and thresholds["email"] == 2.0  # no examples, hence nothing is added


def test_many_matches_and_overlaps(spark):
    text = " ".join(f"u{k}@h.io" for k in range(3000))
    rows = spark.createDataFrame([(1, text), (1, text), (2, "a@b.co")], "doc_id long, text string")
    got = pii.report(rows).collect()
    assert sorted(r["n_email"] for r in got) == [1, 3000, 3000]
    want = base(text)
    assert {r["base_sha256"] for r in got if r["doc_id"] == 1} == {hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()}


def test_redaction_of_overlaps(spark):
    rows = spark.createDataFrame([(1, "to +10.20.30.40 and a@b.co", 1)], "doc_id long, text string, spans int")
    out = pii.redact(rows).collect()
    assert [tuple(r) for r in out] == [(1, "to <PHONE> and <EMAIL>", 1)]


def test_encoder_of_another_file():
    """Rules that differ from those the shortcut relies on: texts are encoded whole."""
    coder = tokens.Encoder(tokenizer_path("byte_bpe_50k.json"))
    texts = ["Hello  World's\n", "", "  x\ty é 123 "]
    assert not coder.by_words and tokens.Encoder(tokenizer_path()).by_words
    assert [x.tolist() for x in coder.encode(texts)] == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_equals_whole_texts():
    """Splitting, remembering and encoding words together changes no id, also when the memory overflows."""
    rng = random.Random(3)
    marks = "aZ éÉİıΣς'’s't 12 \u0085\x1c\t\n,.!--_ßǅªºŉ×÷é中文ﬁĿ\u200b\ufeff"
    texts: list = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["".join(rng.choice("aeiounrst ,E") for _ in range(rng.randint(0, 300))) for _ in range(500)]
    coder = tokens.Encoder(tokenizer_path(), remembered=2000)
    for at in range(0, len(texts), 700):
        part = texts[at : at + 700]
        for text, ids in zip(part, coder.encode(part), strict=True):
            assert list(ids) == coder.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert [len(x) for x in coder.encode([None, "", "  "])] == [0, 0, 0] and coder.encode([]) == []


def test_coded_words(docs):
    """Columnar lookup numbers the same words as a plain loop."""
    texts = [r["text"] for r in docs.select("text").collect()] + [None, "", " .. ", "(The) THE the, İx ÉTÉ!"]
    plain = [[w for x in (t or "").split() if (w := x.lower().strip(".,;:!?\"()[]{}"))] for t in texts]
    known = sorted({w for p in plain for w in p})[::2]
    number = {w: k for k, w in enumerate(known)}
    at = 0
    for first, ids, ends in decontaminate.coded(pa.array(texts, pa.string()), pa.array(known, pa.string())):
        assert first == at
        for a, b in zip(ends, ends[1:], strict=False):
            want = [number.get(w, -1) for w in plain[at]]
            assert ids[a:b].tolist() == want or "İ" in texts[at]
            at += 1
    assert at == len(texts)


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 50_000, 3000), rng.integers(0, 3, 1500), np.array([7]), np.array([5] * 600)):
        built = tokens.WaveletMatrix.build(ids.astype(np.uint32))
        m = tokens.WaveletMatrix.load(built.n, *built.fields())
        assert (m.decode() == ids).all()
        for pos in rng.integers(0, len(ids), 20).tolist():
            token = int(ids[pos])
            assert m.access(pos) == token and m.rank(token, pos) == (ids[:pos] == token).sum()
            assert m.select(token, m.rank(token, pos)) == pos and m.count(token) == (ids == token).sum()
        assert m.count(60_001) == 0
        with pytest.raises(IndexError):
            m.access(len(ids))


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    more = ["It's <|endoftext|> ABC<|ENDOFTEXT|> ΣΑΣ ǅ don't. 123abc 12,5 a--b 中文字\u3000x ... wörd*** ß ﬁ ª Ⅷ", "a\u00a0b\x1cc\x85d \ufeffz"]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(more, 100)), "doc_id long, text string"))
    got = sorted(tokens.token_digest(rows, tokenizer_path(), shard_tokens=500).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["start"]))
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    start = 0
    for r in got:
        ids = np.array([*tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == rows.count()
    assert tokens.token_digest(docs.limit(0), tokenizer_path()).count() == 0


def exact_classes(rows):
    """Connected components of pairs with a probability Jaccard similarity of 0.8 or more, pair by pair."""
    known = probminhash._Words()
    sets = []
    for _, t in rows:
        _, h, w = probminhash.shingles([t or ""], known)
        sets.append((h, w))
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] or "") == (rows[b][1] or "") or probminhash.similarity(*sets[a], *sets[b]) >= 0.8:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, least.get(root(k))) for k, (i, _) in enumerate(rows)]


def near_rows():
    rng = np.random.default_rng(11)
    first = [f"v{k}" for k in rng.integers(0, 900, 120)]
    rows = [(k, " ".join(rng.choice(900, 80).astype(str))) for k in range(40)]
    for k in range(60):
        w = list(first)
        for at in rng.integers(0, 120, int(rng.integers(0, 4))):
            w[at] = f"new{rng.integers(0, 10**6)}"
        rows.append((100 + k, " ".join(w)))
    return rows + [(300 + k, "same text of six words here") for k in range(5)] + [(400, None), (401, ""), (402, "one"), (403, "one"), (None, "one"), (None, "alone"), (404, " ".join(["die"] * 50)), (405, " ".join(["die"] * 51))]


def test_near_duplicates(spark, docs):
    rows = near_rows()
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = probminhash.near_duplicates(d).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == Counter(exact_classes(rows))
    one = probminhash.deduplicate(docs)
    assert one.columns == docs.columns and one.count() == len({c for _, c in exact_classes([(r["doc_id"], r["text"]) for r in docs.collect()])})
    assert probminhash.near_duplicates(docs.limit(0)).count() == 0


def dense_rows(n, seed=5):
    """Near copies of one text with two to nine changes each, some of them shared and some
    cuts of its end: most pairs lie below 0.8, in buckets that hold hundreds of texts."""
    rng = np.random.default_rng(seed)
    first = [f"v{k}" for k in range(150)]
    shared = [(int(rng.integers(0, 150)), f"shared{k}") for k in range(12)]
    rows = []
    for k in range(n):
        w = list(first)
        for at, word in (shared[j] for j in rng.choice(12, int(rng.integers(0, 5)), replace=False)):
            w[at] = word
        for at in rng.integers(0, 150, int(rng.integers(2, 6))):
            w[at] = f"new{rng.integers(0, 10**6)}"
        rows.append((k, " ".join(w[: 150 - 8 * int(rng.integers(0, 5))])))
    return rows


def test_dense_group(spark, monkeypatch):
    # small parts and few rare shingles, so that cells and both kinds of residual pairs occur
    monkeypatch.setattr(probminhash, "PART", 32)
    monkeypatch.setattr(probminhash, "RARE", 20)
    rows = dense_rows(2000)
    # no text repeats a shingle, so the similarity is plain Jaccard: all pairs at once by counts of common shingles
    known = probminhash._Words()
    sets = [set(probminhash.shingles([t], known)[1].tolist()) for _, t in rows]
    number = {h: k for k, h in enumerate(sorted(h for h, n in Counter(h for s in sets for h in s).items() if n > 1))}
    held = np.zeros((len(rows), len(number)), np.float32)
    for k, s in enumerate(sets):
        held[k, [number[h] for h in s if h in number]] = 1
    common, size = held @ held.T, np.array([len(s) for s in sets])
    similar = common / (size[:, None] + size[None, :] - common)
    np.fill_diagonal(similar, 1)
    assert np.median(similar) < 0.8
    label = np.arange(len(rows))
    while True:
        least = np.where(similar >= 0.8 - 1e-9, label[None, :], len(rows)).min(1)
        if (least == label).all():
            break
        label = np.minimum(least, label)
    assert len(set(label.tolist())) > 100
    got = probminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == dict(enumerate(label.tolist()))


def test_bound():
    rng = np.random.default_rng(9)
    for _ in range(200):
        ha, hb = (np.unique(rng.integers(0, 40, 60).astype(np.uint64)) for _ in range(2))
        wa, wb = (1 + np.log(rng.integers(1, 4, len(h))) for h in (ha, hb))
        only_a, only_b = wa[~np.isin(ha, hb)].sum(), wb[~np.isin(hb, ha)].sum()
        most = (wa.sum() - only_a) / (wa.sum() + only_b / wb.max())
        assert probminhash.similarity(ha, wa, hb, wb) <= most + 1e-12


def test_similarity_and_sketch():
    rng = np.random.default_rng(3)
    for _ in range(5):
        ha, hb = (np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(2))
        wa, wb = rng.integers(1, 4, len(ha)).astype(float), rng.integers(1, 4, len(hb)).astype(float)
        x, y = dict(zip(ha.tolist(), wa, strict=True)), dict(zip(hb.tolist(), wb, strict=True))
        want = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())
        assert probminhash.similarity(ha, wa, hb, wb) == pytest.approx(want)
        regs = probminhash.sketch(2, np.repeat([0, 1], [len(ha), len(hb)]), probminhash.mix64(np.concatenate([ha, hb])), np.concatenate([wa, wb]), 4096)
        assert (regs[0] == regs[1]).mean() == pytest.approx(want, abs=0.04)


def test_components(spark):
    nodes = spark.createDataFrame([(bytearray([k]), bytearray([k])) for k in range(20)], "fp binary, label binary")
    links = spark.createDataFrame([(bytearray([a]), bytearray([b])) for a, b in pairwise(range(12))] + [(bytearray([15]), bytearray([14]))], "a binary, b binary")
    got = {bytes(r["fp"])[0]: bytes(r["label"])[0] for r in probminhash.components(nodes, links).collect()}
    assert got == {**{k: 0 for k in range(12)}, 12: 12, 13: 13, 14: 14, 15: 14, **{k: k for k in range(16, 20)}}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    steps, now = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, corpus_pipeline.keep(stage(spark, now, sf_dir), "test")
        assert now.columns == docs.columns and all(texts[r["doc_id"]] == r["text"] for r in now.collect())
        steps[name] = (before, now)
    before, after = steps["MinHash near-dedup"]
    assert {r["doc_id"] for r in after.collect()} == {c for _, c in exact_classes([(r["doc_id"], r["text"]) for r in before.collect()])}
    out = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in now.collect())


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls, repeated rows, clashing columns, and tables without rows."""
    import corpus_pipeline

    rows = [(k, t, "en", f"s{k % 2}", len(t or ""), "x", k % 3, "y") for k, t in enumerate(TEXTS[:6] + ["plain words of some length here " * 9])] * 2 + [(None, "nobody", None, None, None, None, None, None)]
    odd = spark.createDataFrame(rows, DOCS)
    marked = spark.createDataFrame([(0, 1, 0), (3, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, None), (None, "x"), (2, "zz yy xx ww vv uu tt")], "item_id long, text string")
    for k, (d, y, b) in enumerate([(odd, marked, items), (odd.limit(0), marked.limit(0), items.limit(0))]):
        for name, t in (("documents", d), ("labels", y), ("benchmark", b)):
            t.write.parquet(f"{tmp_path}/{k}/{name}.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{k}").collect()
        # without labels of either class every document is kept; one of each group of copies stays
        assert (len(out) > 0) == (k == 0)
        assert {r["doc_id"] for r in out} <= {r[0] for r in rows}
