"""N-gram Jaccard join: a size-aware heavy-light set join that returns exact link components.

Equal sets are one node first. A pair links if ``den * |A & B| >= num * |A | B|``. Two ways find pairs,
split by set size at a boundary that the cost of both over the size histogram decides:

* light sets enumerate the subsets of the size that a link needs. Sets that share such a subset are linked,
  so a bucket's members join its least node and nothing is compared;
* heavy sets are found by inverted lists. The first shingles by hash of linked sets have several in common, so a
  set stays only if that many of its own occur in another set's. Of what stays (near copies, mostly) the
  inverted lists of the rarest shingles of each set, enough that linked sets meet in one, join each list's
  members to its least node; the clusters this makes hold every possible link. In a cluster the inverted lists of all
  shingles are scanned, in blocks of bounded size, then across blocks for what isn't one component by then, and
  only a spanning forest of the links leaves a task.

No step lists the pairs of a group, and nothing is capped.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import MULTIPLIERS, U64, Scratch, Words, arrow_map, chunks, cut, mix, shingles, signed, utf8
from .components import connected_components


class Threshold:
    """Sizes and overlaps for Jaccard >= num/den."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def overlap(self, n: int, m: int) -> int:
        """Least intersection of linked sets of n and m members."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def partners(self, n: int) -> range:
        return range(-(-self.num * n // self.den), self.den * n // self.num + 1)

    def common(self, n: int) -> int:
        """Shingles that the prefix of n is made to have in common with a linked set's prefix."""
        return max(1, int((0.05 + 0.5 * (1 - self.num / self.den)) * n))

    def needed(self, n: int) -> int:
        """The same if the linked set is the smallest there can be."""
        return min(self.common(n), self.common(self.partners(n)[0]))

    def prefix(self, n: int, common: int = 1) -> int:
        """Length of the first part, in any order that all sets share, that has ``common`` shingles in common
        with the like part of any linked set (of one size or another)."""
        return min(n, n - -(-self.num * n // self.den) + common)

    def light_rows(self, n: int) -> int:
        return sum(comb(n, n - self.overlap(n, m)) for m in self.partners(n) if self.overlap(n, m) <= min(n, m))

    def heavy_rows(self, n: int) -> int:
        return self.prefix(n, self.common(n))


def boundary(t: Threshold, histogram: dict[int, int], scan_weight: float = 0.5, most: int = 64) -> int:
    """Greatest light size at the least cost. A light set costs its subsets; a heavy one its prefix rows and,
    for shipping and scanning, ``scan_weight`` for each member. Sizes with partners on both sides pay both."""
    few = {n: c for n, c in histogram.items() if 0 < n <= 2 * most}

    def cost(x: int) -> float:
        return sum(
            c * ((t.light_rows(n) if n <= x else 0) + (t.heavy_rows(n) + scan_weight * n if t.partners(n)[-1] > x else 0)) for n, c in few.items()
        )

    return min(range(most + 1), key=cost)


@functools.cache
def _left_out(n: int, d: int) -> np.ndarray:
    return np.array(list(combinations(range(n), d)), np.int64).reshape(comb(n, d), d)


def light_keys(t: Threshold, members: np.ndarray, light: int) -> list[tuple[np.ndarray, bool, bool]]:
    """(keys, is the smaller size, sizes differ) for each partner size up to the boundary."""
    n, out = len(members), []
    values = mix(members ^ MULTIPLIERS[40])
    total = np.add.reduce(values)
    for m in t.partners(n):
        need = t.overlap(n, m)
        if m > light or need > min(n, m):
            continue
        gone = _left_out(n, n - need)
        rest = total - (values[gone].sum(1, dtype=U64) if gone.shape[1] else np.zeros(1, U64))
        tag = np.add.reduce(np.array([min(n, m), max(n, m)], U64) * MULTIPLIERS[41:43])
        out.append((mix(rest ^ tag), n <= m, n != m))
    return out


def set_node(members: np.ndarray) -> int:
    """64-bit identity of a set."""
    terms = np.concatenate([mix(members ^ MULTIPLIERS[50]), np.array([len(members)], U64) * MULTIPLIERS[51:52]])
    return int(signed(mix(np.add.reduce(terms, keepdims=True)))[0])


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    data, offsets = utf8(column)
    for i, j in chunks(offsets):
        yield from shingles(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), k)


def document_sets(docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """``key, n_shingles, node``; the node is null for an empty set."""
    kind = docs.schema[key].dataType.simpleString()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(len(s), set_node(s) if len(s) else None) for s in _sets(batch.column(1), k)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], [key, "n_shingles", "node"])

    return arrow_map(docs.select(key, text), each, f"{key} {kind}, n_shingles long, node long")


ROLE_EQUAL, ROLE_SMALL, ROLE_LARGE = 0, 1, 2


def light_edges(docs: DataFrame, t: Threshold, light: int, k: int, text: str) -> DataFrame:
    """``a, b``: links of light sets, each bucket's members joined to its least node, or to the least of the other
    size. A window over the bucket (a sort that spills) finds the least nodes; of sets of one size in a
    bucket, a batch sends the first and joins the others to it at once, so a hot bucket stays small."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        sigs, nodes, roles, seen = [], [], [], set()
        for s in _sets(batch.column(0), k):
            if not 0 < len(s) <= light or (node := set_node(s)) in seen:
                continue
            seen.add(node)
            for keys, small, differ in light_keys(t, s, light):
                sigs.append(keys)
                nodes.append(np.full(len(keys), node))
                roles.append(np.full(len(keys), (ROLE_SMALL if small else ROLE_LARGE) if differ else ROLE_EQUAL, np.int8))
        if not sigs:
            return None
        sig, node, role = signed(np.concatenate(sigs)), np.concatenate(nodes), np.concatenate(roles)
        order = np.lexsort((node, sig))
        sig, node, role = sig[order], node[order], role[order]
        first = np.concatenate([[True], sig[1:] != sig[:-1]])
        head = np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))
        joined = ~first & (role == ROLE_EQUAL)
        return pa.RecordBatch.from_arrays([pa.array(np.where(joined, node, sig)), pa.array(node), pa.array(role), pa.array(node[head], mask=~joined)], ["sig", "node", "role", "leader"])

    rows = arrow_map(docs.select(text), each, "sig long, node long, role byte, leader long")
    bucket = W.partitionBy("sig")
    least = lambda when: F.min(F.when(when & F.col("leader").isNull(), F.col("node"))).over(bucket)
    role = F.col("role")
    seen = rows.withColumns({"low": least(role == ROLE_EQUAL), "small": least(role == ROLE_SMALL), "large": least(role == ROLE_LARGE)})
    to = F.when(F.col("leader").isNotNull(), F.col("leader")).when(role == ROLE_EQUAL, F.col("low")).when(role == ROLE_SMALL, F.col("large")).otherwise(F.col("small"))
    return seen.select(F.col("node").alias("a"), to.alias("b")).where("b IS NOT NULL AND a <> b").distinct()


OPEN, KNOWN = -1, -2


def survivors(docs: DataFrame, t: Threshold, light: int, k: int, text: str) -> DataFrame:
    """``node``: heavy sets that have as many prefix shingles in other sets' prefixes as a link needs.

    A batch settles what it can: a shingle of two of its sets is shared, goes out once (KNOWN) for the sake of
    other batches, and its sets get a count row instead (``extra``, under a key of its own)."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        sigs, nodes, wants, seen = [], [], [], set()
        for s in _sets(batch.column(0), k):
            n = len(s)
            if not n or t.partners(n)[-1] <= light or (node := set_node(s)) in seen:
                continue
            seen.add(node)
            own = s[: t.prefix(n, t.common(n))]  # sets are in order of their hashes
            sigs.append(own)
            nodes.append(np.full(len(own), node))
            wants.append((node, t.needed(n)))
        if not sigs:
            return None
        sig, node = np.concatenate(sigs), np.concatenate(nodes)
        order = np.argsort(sig, kind="stable")
        sig, node = sig[order], node[order]
        same = sig[1:] == sig[:-1]
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        first = np.concatenate([[True], ~same])
        names, counts = np.unique(node[shared], return_counts=True)
        found = dict(zip(names.tolist(), counts.tolist(), strict=True))
        # what a set still needs, as a row of its own: the sum over all its rows then has to be 0 or less
        own = np.array([x for x, _ in wants])
        still = np.array([max(0, need - found.get(x, 0)) for x, need in wants])
        extra = np.where(shared[first], KNOWN, OPEN)
        key = mix(own.view(U64) ^ MULTIPLIERS[52])
        return pa.RecordBatch.from_arrays(
            [pa.array(signed(np.concatenate([sig[first], key]))), pa.array(np.concatenate([node[first], own])), pa.array(np.concatenate([extra, still]).astype(np.int32))], ["sig", "node", "extra"]
        )

    rows = arrow_map(docs.select(text), each, "sig long, node long, extra int")
    of_sig = W.partitionBy("sig")
    seen = rows.withColumns({"low": F.min("node").over(of_sig), "high": F.max("node").over(of_sig), "known": F.min("extra").over(of_sig)})
    hit = (F.col("extra") == OPEN) & ((F.col("low") != F.col("high")) | (F.col("known") == KNOWN))
    # the same set in several batches needs the most that any of its rows lacks at most; the least will do
    counted = seen.where(hit | (F.col("extra") >= 0)).groupBy("node").agg(F.countDistinct(F.when(hit, F.col("sig"))).alias("hits"), F.min(F.when(F.col("extra") >= 0, F.col("extra"))).alias("still"))
    return counted.where("hits >= still").select("node")


def rare_edges(sets: DataFrame, t: Threshold, keep: Scratch) -> DataFrame:
    """``a, b``: lists of each set's rarest shingles, as many as a link can't avoid, join members to the list's least
    node. A shingle of one set alone is the rarest there is: it only takes up room in its set's prefix. Linked sets
    both have the rarest shingle they share among these, so a set that holds one elsewhere is no member of its list."""

    def explode(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8(batch.column(1))
        size = np.diff(offsets) // 8
        room = np.array([t.prefix(n) - n for n in size.tolist()], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data.tobytes(), np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), size)), pa.array(np.repeat(room, size).astype(np.int32))], ["sig", "node", "room"])

    rows = arrow_map(sets.select("node", "members"), explode, "sig long, node long, room int")
    shared = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    of_node = W.partitionBy("node")
    ranked = rows.join(shared, "sig").withColumns({"rank": F.row_number().over(of_node.orderBy("df", "sig")), "shared": F.count(F.lit(1)).over(of_node)})
    members = keep.stored(ranked.where("rank <= room + shared").select("sig", "node"))
    lists = members.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low")).where("n > 1")
    return members.join(lists, "sig").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()


def scanned_links(t: Threshold, left: list[np.ndarray], right: list[np.ndarray] | None, root: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets by scanning inverted lists: of ``left`` among themselves (right None) or with
    ``right``; positions count on from left into right. Only links that join two components; ``root``: those known before."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets])
    indexed = sets if right is None else right
    base = 0 if right is None else len(left)
    owner = np.repeat(np.arange(base, base + len(indexed)), [len(s) for s in indexed])
    values = np.concatenate(indexed)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    root = np.arange(len(sets)) if root is None else root.copy()
    links = []
    for i in range(len(left)):
        if (root[i + 1 if right is None else base :] == root[i]).all():
            continue
        a, b = np.searchsorted(values, sets[i]), np.searchsorted(values, sets[i], side="right")
        length = b - a
        heads = np.cumsum(length) - length
        hit = owner[np.arange(int(length.sum())) - np.repeat(heads - a, length)]
        shared = np.bincount(hit, minlength=len(sets))
        if right is None:
            shared[: i + 1] = 0
        near = np.flatnonzero((shared > 0) & (t.den * shared >= t.num * (sizes + sizes[i] - shared)))
        for r in np.unique(root[near]):
            if r != root[i]:
                j = int(near[root[near] == r][0])
                links.append((i, j))
                root[root == r] = root[i]
    return links


def node_sets(docs: DataFrame, wanted: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """``node, n_shingles, members`` (8 bytes a shingle) for ``wanted(key, node)``."""
    texts = docs.select(key, text).join(wanted.select(key, "node"), key)

    def with_set(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes = batch.column(1).to_pylist()
        # a row whose key is another row's too may have another set: only the node's own set counts
        found = [s.tobytes() if len(s) and set_node(s) == n else None for s, n in zip(_sets(batch.column(0), k), nodes, strict=True)]
        size = pa.array([len(x) // 8 if x else 0 for x in found], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(1), size, pa.array(found, pa.binary())], ["node", "n_shingles", "members"])

    sets = arrow_map(texts.select(text, "node"), with_set, "node long, n_shingles long, members binary")
    return sets.where("members IS NOT NULL").dropDuplicates(["node"])


def _scanned(groups: DataFrame, t: Threshold, *keys: str) -> DataFrame:
    """``a, b``: links in groups of ``node, members``; with a column ``left`` (and ``component``), only of left ones
    with others, of different components. The groups are dealt by all keys, however they lie."""
    sided = "left" in groups.columns

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["left", "node"] if sided else "node", ascending=[False, True] if sided else True)
        own, nodes = [np.frombuffer(x, U64) for x in group["members"]], group["node"].to_numpy()
        if sided:
            n, root = int(group["left"].sum()), np.unique(group["component"], return_inverse=True)[1]
            found = scanned_links(t, own[:n], own[n:], root) if 0 < n < len(own) else []
        else:
            found = scanned_links(t, own, None)
        return pd.DataFrame([(int(nodes[x]), int(nodes[y])) for x, y in found], columns=["a", "b"]).astype("int64")

    return groups.repartition(*keys).groupBy(*keys).applyInPandas(scan, "a long, b long")


def verified_links(sets: DataFrame, clusters: DataFrame, t: Threshold, block_sets: int, block_shingles: int, keep: Scratch) -> DataFrame:
    """``sets(node, n_shingles, members)`` (a table of ``keep``, done with here), ``clusters(node, cluster)`` -> ``a, b``:
    links with the components of all links.

    A cluster is dealt into blocks of bounded size. First each block is scanned alone, then one set of each component
    found with those of other blocks. What is one component by then is compared no more: only sets outside
    their cluster's largest component meet those of other components, block by block."""
    sizes = sets.select("node", "n_shingles").join(clusters, "node").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    blocks = lambda n, s: F.greatest(F.ceil(n / block_sets), F.ceil(s / block_shingles), F.lit(1)).cast("int")
    dealt = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    sizes = sizes.select("cluster", blocks(F.col("n"), F.col("s")).alias("blocks"))
    placed = sets.join(clusters, "node").join(sizes, "cluster").withColumn("block", dealt(F.col("blocks")))
    placed = keep.stored(placed.select("node", "cluster", "n_shingles", "members", "blocks", "block"))
    keep.drop(sets)
    links = cut(_scanned(placed.select("node", "cluster", "block", "members"), t, "cluster", "block"))
    large = placed.where("blocks > 1")
    if not large.limit(1).count():
        return links
    names = large.select("node", "cluster", "n_shingles", "blocks")

    def labelled(links: DataFrame) -> DataFrame:
        """``node, cluster, n_shingles, blocks, component`` of the large clusters."""
        found = connected_components(links)
        return names.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))

    firsts = labelled(links).where("node = component")
    few = firsts.groupBy("cluster").agg(blocks(F.count(F.lit(1)), F.sum("n_shingles")).alias("few"))
    firsts = firsts.join(few, "cluster").select("node", dealt(F.col("few")).alias("part"))
    links = cut(links.union(_scanned(large.join(firsts, "node").select("node", "cluster", "part", "members"), t, "cluster", "part")))
    now = cut(labelled(links))
    by_size = now.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    outside = F.struct(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "s", "component")).alias("top"), F.count(F.lit(1)).alias("components"))
    tops = by_size.groupBy("cluster").agg(outside.alias("x")).where("x.components > 1")
    tops = tops.select("cluster", F.col("x.top.component").alias("top"), blocks(F.col("x.n") - F.col("x.top.n"), F.col("x.s") - F.col("x.top.s")).alias("lefts"))
    open_sets = now.join(tops, "cluster").select("node", "cluster", "blocks", "component", "top", "lefts")
    left = open_sets.where("component <> top").select("node", "component", F.lit(True).alias("left"), "cluster", dealt(F.col("lefts")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    right = open_sets.select("node", "component", F.lit(False).alias("left"), "cluster", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"), dealt(F.col("blocks")).alias("j"))
    grid = left.union(right).join(large.select("node", "members"), "node")
    return links.union(_scanned(grid, t, "cluster", "i", "j"))


def jaccard_components(
    docs: DataFrame, num: int = 90, den: int = 100, k: int = 3, key: str = "doc_id", text: str = "text",
    block_sets: int = 500, block_shingles: int = 4_000_000, light: int | None = None,
) -> DataFrame:
    """``key, n_shingles, component_id``: the least key reachable by links, one row per row of ``docs``.

    Null and empty texts, and texts without words, have 0 shingles and link with nothing; a text of fewer
    than k words has its whole sequence as one. Ties can't occur: components don't depend on order.
    Repeated rows come back repeated in one component; a null key stays null and is no component's least.
    Other columns aren't read. An empty table gives an empty one.
    """
    with Scratch(docs.sparkSession) as keep:
        return cut(_components(docs, Threshold(num, den), k, key, text, block_sets, block_shingles, light, keep))


def _components(docs: DataFrame, t: Threshold, k: int, key: str, text: str, block_sets: int, block_shingles: int, light: int | None, keep: Scratch) -> DataFrame:
    base = cut(document_sets(docs, k, key, text))
    if light is None:
        histogram = {r.n_shingles: r["count"] for r in base.where("n_shingles BETWEEN 1 AND 128").groupBy("n_shingles").count().collect()}
        light = boundary(t, histogram)
    owners = base.where("node IS NOT NULL").groupBy("node").agg(F.min(key).alias(key), F.max("n_shingles").alias("n_shingles"))
    found = light_edges(docs, t, light, k, text) if light else None
    heavy = cut(survivors(docs, t, light, k, text))
    wanted = owners.where(F.col(key).isNotNull()).join(heavy, "node")
    sets = keep.stored(node_sets(docs, wanted, k, key, text))
    clusters = connected_components(cut(rare_edges(sets, t, keep))).select("node", F.col("component").alias("cluster"))
    links = verified_links(sets, clusters, t, block_sets, block_shingles, keep)
    links = cut(links.union(found) if found is not None else links)
    joined = connected_components(links)
    least = owners.select("node", F.col(key).alias("_least")).join(joined, "node").groupBy("component").agg(F.min("_least").alias("component_id"))
    of_node = owners.select("node", F.col(key).alias("_own")).join(joined, "node", "left").join(least, "component", "left")
    of_node = of_node.select("node", F.coalesce("component_id", "_own").alias("component_id"))
    return base.join(of_node, "node", "left").select(key, "n_shingles", F.coalesce("component_id", key).alias("component_id"))
