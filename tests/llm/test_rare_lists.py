"""Lists of the rarest shingles hold only sets that have the shingle in their prefix."""

import numpy as np

from triplane.llm import components, ngram_join
from triplane.llm.common import Scratch


def joined(n, pairs):
    root = list(range(n))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


def clusters(spark, sets):
    rows = [(i, len(s), np.array(sorted(s), np.int64).tobytes()) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "node long, n_shingles long, members binary")
    with Scratch(spark) as keep:
        edges = ngram_join.rare_edges(keep.stored(table), ngram_join.Threshold(90, 100), keep)
        found = {r.node: r.component for r in components.connected_components(edges).collect()}
    return [found.get(i, i) for i in range(len(sets))]


def test_passages_of_one_set_join_no_others(spark):
    """Set 0 holds a shingle of every triple, but its own shingles fill its prefix."""
    sets = [set(range(50)) | {1000 * i for i in range(1, 11)}]
    for i in range(1, 11):
        sets += [set(range(1000 * i + 1, 1000 * i + 19)) | {1000 * i + own} for own in (0, 500, 600)]
    assert clusters(spark, sets) == [0, *(3 * (i // 3) + 1 for i in range(30))]


def test_clusters_are_those_of_the_prefixes(spark):
    rng = np.random.default_rng(7)
    t = ngram_join.Threshold(90, 100)
    sets = []
    for _ in range(60):
        own = rng.integers(10_000, 10**9, int(rng.integers(10, 80)))
        base = np.concatenate([own, rng.integers(0, 300, int(rng.integers(0, 12)))])
        sets.append(set(base.tolist()))
        for _ in range(int(rng.integers(0, 3))):
            gone = rng.permutation(len(base))[int(rng.integers(0, 4)) :]
            sets.append({*base[gone].tolist(), *rng.integers(10_000, 10**9, int(rng.integers(0, 3))).tolist()})
    df = {x: sum(x in s for s in sets) for x in set().union(*sets)}
    prefix = [set(sorted(s, key=lambda x: (df[x], x))[: t.prefix(len(s))]) for s in sets]
    both = [(i, j) for i in range(len(sets)) for j in range(i)]
    found = clusters(spark, sets)
    assert found == joined(len(sets), [(i, j) for i, j in both if prefix[i] & prefix[j]])
    links = [(i, j) for i, j in both if t.den * len(sets[i] & sets[j]) >= t.num * len(sets[i] | sets[j])]
    assert links and all(found[i] == found[j] for i, j in links)
