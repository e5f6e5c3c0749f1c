"""A row that is repeated very often is dealt out in pieces."""

from humsearch.llm import mixing


def test_report_of_many_repeats(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 16)
    rows = [(1, "same words here", "a")] * 1000 + [(2, "other words", "a"), (3, "b words", "b"), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_report(docs).collect()
    count = {k: sum(r["doc_id"] == k for r in got) for k in (1, 2, 3, 4)}
    assert count == {1: 1000, 2: 1, 3: 1, 4: 1}
    mixed = {r["doc_id"]: 0 for r in mixing.mix_documents(docs).collect()}
    for r in mixing.mix_documents(docs).collect():
        mixed[r["doc_id"]] += 1
    taken = {k: sum(r["copies"] for r in got if r["doc_id"] == k) for k in count}
    assert mixed == {k: n for k, n in taken.items() if n}
