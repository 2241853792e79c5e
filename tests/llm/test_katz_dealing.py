"""Chunks stay small whatever the keys are, and rows of null and repeated keys are scored each."""

from __future__ import annotations

from pyspark.sql import functions as F

from triplane.llm import katz

from .test_operators import prose


def test_null_and_repeated_keys(spark):
    texts = [" ".join(prose(40)) for _ in range(300)]
    rows = [(None, t) for t in texts[:100]] + [(7, t) for t in texts[100:200]] + [(1000 + i, t) for i, t in enumerate(texts[200:])]
    rows += [(8, texts[0])] * 5000 + [(None, None)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    train = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True))
    chunk = katz.chunk_table(docs, train, 20_000, "doc_id", "text").select(F.size("keys").alias("n"), F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b).alias("tokens")).collect()
    assert sum(r.n for r in chunk) == len(rows) and max(r.tokens for r in chunk) < 8000
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, round(r.score, 6), r.n_known, r.train_tokens)
    got = sorted(map(key, katz.score_documents(docs, train, chunk_bytes=20_000).collect()))
    want = sorted(map(key, katz.score_documents(docs, train, chunk_bytes=1 << 30).collect()))
    assert len(got) == len(rows)
    assert got == want
