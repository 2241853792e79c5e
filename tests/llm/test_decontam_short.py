"""Items of a few words whole in longer documents: none is missed; any number of items is one pass over the documents."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from triplane.llm import decontam

from .test_operators import prose, shingle_set


@pytest.fixture(scope="module")
def planted():
    """(items, documents): a short item, with a shingle of five or more lacking, in each document."""
    rng = np.random.default_rng(2)
    items = [" ".join(f"{w}{i}" for w in prose(5 + i % 9)) for i in range(300)]
    docs = []
    for i in range(900):
        text = prose(int(rng.integers(60, 120)))
        at = int(rng.integers(0, len(text)))
        item = items[i % len(items)].split()
        item = item[: len(item) - (len(item) >= 9)]
        docs.append(" ".join(text[:at] + item + text[at:]))
    return items, docs


def found(spark, items, docs, **options):
    """(document, item, shared), by their places."""
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    return sorted(tuple(r)[:3] for r in decontam.contaminated(rows, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), **options).collect())


def test_short_items_inside_long_documents(spark, planted):
    items, docs = planted
    sets = [shingle_set(x, 5) for x in items]
    want = {(d, d % len(items)) for d, text in enumerate(docs) if len(sets[d % len(items)] & shingle_set(text, 5)) >= 0.8 * len(sets[d % len(items)])}
    small = {(d, n) for d, n in want if len(sets[n]) < decontam.BLOCK}
    assert {len(sets[n]) for _, n in small} >= {1, 2, 3, 4, 5, 6, 7}
    got = {(d, n) for d, n, _ in found(spark, items, docs)}
    assert got >= small and got <= want
    assert [x for x in found(spark, items, [items[0] + " " + items[0]]) if x[1] == 0] == [(0, 0, 1)]


def test_filters_decide_nothing(spark, planted):
    items, docs = planted
    assert found(spark, items, docs, filter_bits=64) == found(spark, items, docs)


def test_many_items_are_one_pass(spark, tmp_path):
    """More items than any block of a driver, and one of them in a third of the documents."""
    items = [" ".join(prose(20 + i % 30)) for i in range(12_000)]
    docs = [" ".join([*prose(40), items[7 if i % 3 else i], *prose(20)]) for i in range(600)]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.read.parquet(str(tmp_path / "docs")).mapInArrow(counted, "doc_id long, text string")
    got = decontam.contaminated(rows, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} >= {(i, 7 if i % 3 else i) for i in range(600)}
    assert read.value == len(docs)
    sets = {n: shingle_set(items[n], 5) for n in {r.item_id for r in got.collect()}}
    for r in got.where(F.col("doc_id") < 50).collect():
        both = len(sets[r.item_id] & shingle_set(docs[r.doc_id], 5))
        assert r.shared == both and r.containment == both / len(sets[r.item_id]) >= 0.8
