"""Benchmark decontamination: size-partitioned MinHash containment search for short items in long documents.

Items are partitioned by size (powers of two of their shingle count). For each size class a document is cut
into overlapping windows of a few times that size, so the sizes that MinHash compares stay within a known
ratio however long the document is, and a window's signature is the minimum over its blocks' signatures.
A window and an item that agree on any hash make the item a candidate (items of less than a block, for which
windows are too wide, are looked up by their shingles), which the exact containment of its
shingles in the whole document then confirms.

Items are a table of hashes and shingles. One pass over the documents, whatever the number of items, keeps the hashes
and shingles that a filter of bounded size lets through; joins with the items' table find and confirm the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIERS, U64, Scratch, Words, arrow_map, chunks, cut, mix, sequence, shingles, signed, spread, utf8

#: Words of a signature block; windows are whole blocks.
BLOCK = 8


@dataclass(frozen=True)
class Filter:
    """A bit for each remainder of the hashes put in: these all pass, others by chance."""

    words: np.ndarray

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        bit = hashes & U64(64 * len(self.words) - 1)
        return (self.words[bit >> U64(6)] >> (bit & U64(63))) & U64(1) != 0


def bit_filter(hashes: DataFrame, n: int, most: int) -> Filter:
    """Filter of the ``n`` rows of ``hashes(h)``, 32 to 64 bits for each but ``most`` (a power of two) in all. Its words are
    what the driver gets."""
    bits = min(most, max(64, 1 << (32 * n).bit_length()))
    word = F.expr(f"shiftright(h & {bits - 1}L, 6)").alias("word")
    got = hashes.groupBy(word).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63L as int)))").alias("bits")).toPandas()
    words = np.zeros(bits // 64, U64)
    words[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(U64)
    return Filter(words)


class Search:
    def __init__(self, k: int, hashes: int, threshold: float) -> None:
        self.k, self.threshold = k, threshold
        self.scale, self.tag = spread(hashes, 11), spread(hashes, 12)

    def signatures(self, values: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Minima of each hash over runs of values that begin at heads: runs x hashes."""
        out = np.empty((len(heads), len(self.scale)), U64)
        for i, (a, b) in enumerate(zip(self.scale, self.tag, strict=True)):
            out[:, i] = np.minimum.reduceat((values ^ b) * a, heads)
        return out

    def tagged(self, signature: np.ndarray, size_class: int) -> np.ndarray:
        """Equal only for equal minima of one hash and class."""
        return mix((signature ^ self.tag[None, :]) + MULTIPLIERS[:1] * U64(size_class))

    def looked_up(self, values: np.ndarray) -> np.ndarray:
        """Shingles by which items of less than a block are found."""
        return mix(values + MULTIPLIERS[1])

    def sought(self, s: np.ndarray) -> tuple[int, np.ndarray]:
        """Size class of an item (0: less than a block) and the hashes of which a document with it has one."""
        if len(s) >= BLOCK:
            size_class = int(len(s)).bit_length()
            return size_class, self.tagged(self.signatures(s, np.array([0])), size_class)[0]
        lacking = len(s) - max(1, int(np.ceil(self.threshold * len(s) - 1e-9)))
        return 0, self.looked_up(s[: lacking + 1])

    def items(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(row, size class, hashes, shingles) of each item that has words."""
        for i, s in enumerate(shingles(Words(*utf8(texts)), self.k)):
            if len(s):
                yield i, *self.sought(s), s

    def windows(self, own: np.ndarray, at: np.ndarray, classes: list[int], keep: Filter) -> tuple[np.ndarray, np.ndarray]:
        """(document, hash) of the windows of each class; ``own``: shingles of the documents, which begin at ``at``."""
        blocks = -(-np.diff(at) // BLOCK)
        first = np.concatenate([[0], np.cumsum(blocks)])
        doc = np.repeat(np.arange(len(blocks)), blocks)
        nth = np.arange(len(doc)) - first[doc]
        docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
        minima = self.signatures(own, at[doc] + nth * BLOCK) if len(doc) and classes else None
        for c in classes if minima is not None else []:
            step = max(1, -(-(1 << c) // BLOCK))  # blocks that hold the longest item of the class
            # windows of two steps and a block from every step-th block of a document on
            begin = np.flatnonzero(nth % step == 0)
            owner = doc[begin]
            stop = np.minimum(begin + 2 * step + 1, first[owner + 1])
            window = minima[begin]
            for extra in range(1, 2 * step + 1):
                ok = begin + extra < stop
                if not ok.any():
                    break
                window[ok] = np.minimum(window[ok], minima[begin[ok] + extra])
            flat = self.tagged(window, c).ravel()
            hit = np.flatnonzero(keep.passes(flat))
            docs.append(owner[hit // len(self.scale)])
            hashes.append(flat[hit])
        return np.concatenate(docs), np.concatenate(hashes)

    def found(self, column: pa.Array, classes: list[int], keep: Filter, known: Filter) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, hashes, shingles) of the texts with a hash that ``keep`` lets through; their shingles that ``known`` does.
        Class 0 stands for items of less than a block."""
        k = self.k
        data, offsets = utf8(column)
        for i, j in chunks(offsets):
            words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            h, at = words.hash, words.at
            rolled = np.zeros(max(0, len(h) - k + 1), U64)
            for x in range(k if len(rolled) else 0):
                rolled += h[x : len(rolled) + x] * MULTIPLIERS[x]
            rolled = mix(rolled)
            # shingles of the documents that have k words, end to end
            size = np.maximum(np.diff(at) - k + 1, 0)
            begin = np.concatenate([[0], np.cumsum(size)])
            owner = np.repeat(np.arange(len(size)), size)
            own = rolled[at[owner] + np.arange(len(owner)) - begin[owner]]
            # of shorter ones the whole sequence is the only shingle
            short = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < k))
            whole = np.array([sequence(h[at[d] : at[d + 1]]) for d in short.tolist()], U64)
            docs, hashes = self.windows(own, begin, [c for c in classes if c], keep)
            if 0 in classes:
                single = self.looked_up(np.concatenate([own, whole]))
                hit = np.flatnonzero(keep.passes(single))
                docs, hashes = np.concatenate([docs, np.concatenate([owner, short])[hit]]), np.concatenate([hashes, single[hit]])
            order = np.lexsort((hashes, docs))
            docs, hashes = docs[order], hashes[order]
            new = np.ones(len(docs), bool)
            new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
            docs, hashes = docs[new], hashes[new]
            only = dict(zip(short.tolist(), whole, strict=True))
            one, first = np.unique(docs, return_index=True)
            for d, mine in zip(one.tolist(), np.split(hashes, first[1:]), strict=False):
                held = np.array([only[d]], U64) if d in only else own[begin[d] : begin[d + 1]]
                yield i + d, mine, np.unique(held[known.passes(held)])


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) for x in found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(np.concatenate(found))))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, k: int = 5, hashes: int = 48, filter_bits: int = 1 << 27,
    key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``key, item_id, shared, containment``: items of whose k-word shingles a document has ``threshold`` or more.

    Items under BLOCK shingles are looked up exactly, none is missed. Within a window the Jaccard index of a longer
    one that is contained at the default threshold is at least 7 / 41 (8 shingles), and 0.8 / 4.3 from 128 shingles on;
    48 hashes miss it with a chance below 1 in 7,900, and below 1 in 20,000 from 128 on. Items and documents of fewer than k words have their whole sequence as one
    shingle; null texts and texts without words match nothing. Repeated rows on either side match each.
    No benchmark or no documents: an empty table. Other columns aren't read.

    The two filters (of the items' hashes, and of their shingles) have at most ``filter_bits`` bits each, and are all
    that is broadcast by hand; beyond some million items more passes them by chance, which the joins then drop.
    """
    search, spark = Search(k, hashes, threshold), docs.sparkSession

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        got = list(search.items(batch.column(2)))
        if not got:
            return None
        row, size_class, sought, sets = zip(*got, strict=True)
        ids = batch.select([0, 1]).take(pa.array(row))
        return pa.RecordBatch.from_arrays([*ids.columns, pa.array(size_class, pa.int32()), _lists(sought), _lists(sets)], ["item", "item_id", "class", "hashes", "shingles"])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        got = list(search.found(batch.column(2), classes, *filters.value))
        if not got:
            return None
        row, mine, sets = zip(*got, strict=True)
        ids = batch.select([0, 1]).take(pa.array(row))
        return pa.RecordBatch.from_arrays([*ids.columns, _lists(mine), _lists(sets)], ["row", "key", "hashes", "shingles"])

    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    with Scratch(spark) as scratch:
        # a number for each row, as keys may be null or repeated; it is made once, since the rows are stored
        numbered = F.monotonically_increasing_id()
        asked = benchmark.select(numbered.alias("item"), F.col(item_key).alias("item_id"), F.col(item_text).alias("text"))
        items = scratch.stored(arrow_map(asked, describe, f"item long, item_id {kinds[1]}, class int, hashes array<long>, shingles array<long>"))
        total = items.agg(F.collect_set("class").alias("classes"), F.sum(F.size("hashes")).alias("hashes"), F.sum(F.size("shingles")).alias("shingles")).first()
        if not total.classes:
            return spark.createDataFrame([], f"`{key}` {kinds[0]}, item_id {kinds[1]}, shared long, containment double")
        classes = sorted(total.classes)
        of = lambda column: bit_filter(items.select(F.explode(column).alias("h")), total[column], filter_bits)
        filters = spark.sparkContext.broadcast((of("hashes"), of("shingles")))
        rows = docs.select(numbered.alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
        hits = scratch.stored(arrow_map(rows, each, f"row long, key {kinds[0]}, hashes array<long>, shingles array<long>"))
        candidates = hits.select("row", "key", F.explode("hashes").alias("h")).join(items.select("item", F.explode("hashes").alias("h")), "h").select("row", "key", "item").dropDuplicates(["row", "item"])
        wanted = candidates.join(items.select("item", "item_id", F.size("shingles").alias("size"), F.explode("shingles").alias("s")), "item")
        same = wanted.join(hits.select("row", F.explode("shingles").alias("s")), ["row", "s"])
        shared = same.groupBy("row", "item").agg(F.first("key").alias("key"), F.first("item_id").alias("item_id"), F.first("size").alias("size"), F.count("*").alias("shared"))
        confirmed = shared.where(F.col("shared") >= threshold * F.col("size") - 1e-9)
        return cut(confirmed.select(F.col("key").alias(key), "item_id", "shared", (F.col("shared") / F.col("size")).alias("containment")))


def decontaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Rows of ``docs``, all columns, that hold no benchmark item; a row with a null key stays."""
    hit = contaminated(docs, benchmark, key=key, **options).select(F.col(key).alias("_hit")).distinct()
    return docs.join(hit, docs[key] == hit["_hit"], "left_anti")
