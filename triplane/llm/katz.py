"""Katz backoff language model: Good-Turing discounted n-gram counts, backoff weights normalised exactly, in tables
partitioned by history and evaluated recursively for each token.

    P(w)   = (c(w) + 0.1) / (N + 0.1 (V + 1))            V words and one for all unknown ones
    P(w|h) = g(h) d(r) r / C(h)   if r = c(h w) > 0,     else a(h) P(w|h'), h' being h without its first word
    a(h)   = (1 - sum of P(w|h) over seen w) / (1 - sum of P(w|h') over seen w)

d(r) is Katz's Good-Turing discount of the order for r up to 5. g(h) is 1 unless a history leaves less than
1 / (C + 1) to unseen words; then it makes them just that much. A history unseen in training has a = 1.

1. Texts become chunks of bounded size, each with its own dictionary; nothing is dealt by key. The words of all
   dictionaries are counted and numbered, frequent ones low, and each chunk learns its words' numbers and counts.
2. Order by order a chunk sends its distinct n-grams, with their training counts, to the buckets of their
   histories. A bucket adds up the counts, which are the model's table of that order (``fit`` keeps it), and answers each chunk with
   the counts of its n-grams and what discounts and backoff weights need of their histories. A history too
   frequent for a bucket has its followers dealt into shares; sums over its shares are joined back.
3. With the answers of an order a chunk knows which histories of the next were seen, and in the end every token.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIERS, SPACE, U64, Scratch, Words, arrow_map, chunks, cut, from_varints, mix, packed, ranked, unpacked, utf8, varints

K = 5
ADD = 0.1
#: Numbers of the beginning and the end of a text; words follow. A word that training lacks has UNKNOWN.
BEGIN, END, FIRST, UNKNOWN = 0, 1, 2, -1
#: Occurrences of a history in training for which its followers are dealt into one more share.
SHARE = 500_000
#: Training tokens for which there is one more bucket.
BUCKET = 1_000_000


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0..K) from the numbers n[r] of n-grams seen r times. Where these give no discount between 0 and 1 (too few
    n-grams), it is r / (r + 1/2)."""
    d = np.ones(K + 1)
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        star = (r + 1) * n[r + 1] / n[r] if n[r] else 0.0
        value = (star / r - common) / (1 - common) if common < 1 else 0.0
        d[r] = value if 0 < value < 1 else r / (r + 0.5)
    return d


def discounted(r: np.ndarray, d: np.ndarray) -> np.ndarray:
    return r * np.where(r <= K, d[np.minimum(r, K)], 1.0)


# Chunks


def _hashes(data: np.ndarray, offsets: np.ndarray, size: int = 2 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts end to end, words of each text. A long text is cut at spaces, so no pass is large."""
    edges, of = [0], []
    for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while b - a > size:
            gap = np.flatnonzero(SPACE[data[a + size : min(a + 2 * size, b)]])
            if not len(gap):
                break
            a += size + int(gap[0])
            edges.append(a)
            of.append(d)
        edges.append(b)
        of.append(d)
    pieces = np.array(edges, np.int64)
    hashes, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for i, j in chunks(pieces, size):
        w = Words(data[pieces[i] : pieces[j]], pieces[i : j + 1] - pieces[i])
        hashes.append(w.hash)
        counts.append(np.diff(w.at))
    n = np.bincount(np.array(of, np.int64), weights=np.concatenate(counts), minlength=len(offsets) - 1).astype(np.int64)
    return np.concatenate(hashes), n


def chunk_table(docs: DataFrame, train: Column, chunk_bytes: int, key: str, text: str) -> DataFrame:
    """``chunk, keys, train, n, words, taught, stream``: the documents of a chunk, its distinct words (hashes, frequent
    ones first) with their training counts, and the texts as places in that list. A chunk is named by the task that
    reads it, so the table has to be stored before it is read twice."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["chunk", "keys", "train", "n", "words", "taught", "stream"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for i, j in chunks(offsets, chunk_bytes):
                h, n = _hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                word, place, count = np.unique(h, return_inverse=True, return_counts=True)
                order = np.argsort(-count, kind="stable")
                rank = np.empty(len(word), np.uint32)
                rank[order] = np.arange(len(word))
                stream = rank[place]
                own = batch.slice(i, j - i)
                flags = own.column(1).to_numpy(zero_copy_only=False)
                taught = np.bincount(stream, weights=np.repeat(flags, n), minlength=len(word)).astype(np.int64)
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                blobs = [pa.array([packed(x)], pa.binary()) for x in (word[order], taught, stream)]
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), one(own.column(0)), one(own.column(1)), one(pa.array(n)), *blobs], names)
                name += 1

    rows = docs.select(F.col(key), F.coalesce(train, F.lit(False)).alias("train"), F.col(text))
    return rows.mapInArrow(each, f"chunk long, keys array<{kind}>, train array<boolean>, n array<long>, words binary, taught binary, stream binary")


def dictionary(chunk: DataFrame) -> DataFrame:
    """``chunk, place, word, c``: the words of all chunks."""

    def listed(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [unpacked(x, U64) for x in batch.column(1).to_pylist()]
        taught = [unpacked(x, np.int64) for x in batch.column(2).to_pylist()]
        size = [len(w) for w in words]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column(0).to_numpy(), size)), pa.array(np.concatenate([np.arange(s, dtype=np.int32) for s in size])), pa.array(np.concatenate(words).view(np.int64)), pa.array(np.concatenate(taught))],
            ["chunk", "place", "word", "c"],
        )

    return arrow_map(chunk.select("chunk", "words", "taught"), listed, "chunk long, place int, word long, c long")


def vocabulary(words: DataFrame, keep: Scratch) -> tuple[DataFrame, int, int]:
    """(``word, id, count`` of the words seen in training, their occurrences, their number). A number is made of the
    place by count within a partition and the partition, so frequent words have low ones and no order of all is needed."""
    counted = words.groupBy("word").agg(F.sum("c").alias("count")).where("count > 0").sortWithinPartitions(F.desc("count"), "word")
    at = F.monotonically_increasing_id()
    counted = keep.stored(counted.select("word", "count", at.alias("at")))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sums = counted.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("v"), F.max(part).alias("parts")).first()
    return counted.select("word", "count", (place * ((sums.parts or 0) + 1) + part + FIRST).alias("id")), sums.n or 0, sums.v


def unit_table(chunk: DataFrame, words: DataFrame, known: DataFrame) -> DataFrame:
    """``chunk, keys, train, n, stream, ids, counts``: chunks with the numbers and training counts of their words."""

    def gathered(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        ids, counts = (t.column(c).to_numpy() for c in ("id", "count"))
        return pa.table({"chunk": t.column("chunk")[:1], "ids": pa.array([packed(ids)], pa.binary()), "counts": pa.array([packed(counts)], pa.binary())})

    looked_up = words.select("chunk", "place", "word").join(known, "word", "left")
    looked_up = looked_up.select("chunk", "place", F.coalesce("id", F.lit(UNKNOWN)).alias("id"), F.coalesce("count", F.lit(0)).alias("count"))
    numbered = looked_up.groupBy("chunk").applyInArrow(gathered, "chunk long, ids binary, counts binary")
    return chunk.select("chunk", "keys", "train", "n", "stream").join(numbered, "chunk", "left")


# N-grams of a chunk


class Unit:
    """A chunk's tokens as places in its dictionary, and n-gram by n-gram what is known of them."""

    def __init__(self, row: dict, ends: int) -> None:
        self.keys, train, n = row["keys"].values, row["train"].values.to_numpy(zero_copy_only=False), row["n"].values.to_numpy()
        blob = lambda c, kind: unpacked(row[c].as_py(), kind) if row[c].is_valid else np.zeros(0, kind)
        stream, ids, counts = blob("stream", np.uint32).astype(np.int64), blob("ids", np.int64), blob("counts", np.int64)
        # places in the order of the words' numbers, so that n-grams come out in the order of histories and words
        ids, counts = np.append(ids, [BEGIN, END]), np.append(counts, [ends, ends])
        order = np.argsort(ids, kind="stable")
        self.size, self.id, self.count = len(ids), ids[order], counts[order]
        place = np.empty(self.size, np.int64)
        place[order] = np.arange(self.size)
        self.begin = place[-2]
        self.n = n + 1
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.token = np.full(self.at[-1], place[-1])
        inner = np.ones(self.at[-1], bool)
        inner[self.at[1:] - 1] = False
        self.token[inner] = place[stream]
        self.train = np.repeat(train, self.n)


class Level:
    """The distinct n-grams of a unit: ``node`` of each token; of each node its history (``of``), last word and training
    count; of each history its words' numbers, the first word's first, and its own history one word shorter. A
    history of two words or more is a node of the order below, plus one; the beginning is ``none``."""

    def __init__(self, unit: Unit, lower: Level | None) -> None:
        self.unit, self.lower = unit, lower
        before = lower.node + 1 if lower else unit.token
        self.none = 0 if lower else unit.begin
        history = np.empty(len(before), np.int64)
        history[1:] = before[:-1]
        history[unit.at[:-1]] = self.none
        pair, _, self.node = ranked(history * unit.size + unit.token)
        self.of, self.word = pair // unit.size, pair % unit.size
        self.n = len(pair)
        self.taught = np.bincount(self.node, weights=unit.train, minlength=self.n).astype(np.int64)
        if lower:
            self.ids = [np.concatenate([[BEGIN], x]) for x in (*(h[lower.of] for h in lower.ids), unit.id[lower.word])]
            self.shorter = np.empty(lower.n + 1, np.int64)
            self.shorter[lower.node + 1] = lower.lower.node + 1 if lower.lower else unit.token
            self.shorter[0] = lower.none
            self.history_count = np.concatenate([unit.count[[unit.begin]], lower.c])
            self.low = np.empty(self.n, np.int64)
            self.low[self.node] = lower.c[lower.node]
        else:
            self.ids, self.shorter, self.history_count, self.low = [unit.id], None, unit.count, unit.count[self.word]

    def ask(self, buckets: int, wave: tuple[int, int] = (0, 1)) -> None:
        """Put what is asked for in the order of buckets (of a wave), histories and words. Not asked for: histories
        without training, and n-grams whose shorter n-gram training lacks."""
        histories = len(self.ids[0])
        alive = self.history_count > 0
        for x in self.ids:
            alive &= x != UNKNOWN
        self.shares = shares = np.maximum(1, -(-self.history_count // SHARE))
        base = np.zeros(histories, U64)
        for x, m in zip(self.ids, MULTIPLIERS, strict=False):
            base = mix(base * MULTIPLIERS[63] + x.astype(U64) * m)
        bucket = (base % U64(buckets)).astype(np.int64)
        nodes = np.flatnonzero(alive[self.of] & (self.low > 0))
        h = self.of[nodes]
        at = bucket[h]
        parted = np.flatnonzero(shares[h] > 1)
        share = mix(self.unit.id[self.word[nodes[parted]]].astype(U64) ^ MULTIPLIERS[61]) % shares[h[parted]].astype(U64)
        at[parted] = mix(base[h[parted]] + share * MULTIPLIERS[62]) % U64(buckets)
        lacks, has, used = (np.zeros(histories, bool) for _ in range(3))
        lacks[self.of[self.low == 0]] = True
        has[h], used[self.of] = True, True
        # a history that has no n-gram in its own bucket goes there for its sums
        alone = np.flatnonzero(alive & used & ((lacks & ~has) | (shares > 1)))
        into = np.searchsorted(h, alone)
        h, at, nodes = np.insert(h, into, alone), np.insert(at, into, bucket[alone]), np.insert(nodes, into, -1)
        if wave[1] > 1:
            own = at % wave[1] == wave[0]
            h, at, nodes = h[own], at[own], nodes[own]
        order = np.argsort(at.astype(np.uint16) if buckets <= 1 << 16 else at, kind="stable")
        h, at, nodes = h[order], at[order], nodes[order]
        head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
        entry = nodes >= 0
        self.nodes, self.records, self.bucket = nodes[entry], h[head], at[head]
        self.length = np.add.reduceat(entry.astype(np.int64), head) if len(head) else head
        self.flags = 2 * shares[self.records] + lacks[self.records]

    def requests(self, name: int) -> pa.Table:
        """A row for each bucket."""
        first = np.flatnonzero(np.concatenate([[True], self.bucket[1:] != self.bucket[:-1]])) if len(self.bucket) else np.zeros(0, np.int64)
        ids = [x[self.records] for x in self.ids]
        word, low = self.unit.id[self.word[self.nodes]], self.low[self.nodes]
        table = _rows(self.bucket[first], np.append(first, len(self.bucket)), ids, self.length, word, self.taught[self.nodes], low, self.flags)
        return table.append_column("chunk", pa.array(np.full(len(first), name), pa.int64())).select(REQUEST_NAMES)

    def answered(self, rows: pa.Table) -> None:
        """Take in the answers: ``c`` of each node; unless only counts came, also of each history how many of its
        n-grams were seen how often, and the sum of their lower weights."""
        t = rows.filter(pc.equal(rows.column("kind"), 0)).sort_by("bucket")
        self.c = np.zeros(self.n, np.int64)
        self.c[self.nodes] = from_varints(utf8(t.column("c"))[0])
        if "stats" not in rows.column_names:
            return
        histories = len(self.ids[0])
        self.stats = np.zeros((histories, K + 1), np.int64)
        self.lows = np.zeros(histories)
        # a parted history has several records, all 0: its sums come as a whole
        self.stats[self.records] = from_varints(utf8(t.column("stats"))[0]).reshape(-1, K + 1)
        self.lows[self.records] = utf8(t.column("low"))[0].view(np.float64)
        whole = rows.filter(pc.equal(rows.column("kind"), 5))
        if whole.num_rows:
            place = {h: i for i, h in enumerate(zip(*(x.tolist() for x in self.ids), strict=True)) if self.shares[i] > 1}
            for h, stats, low in zip(whole.column("h").to_pylist(), whole.column("sums").to_pylist(), whole.column("low_sum").to_pylist(), strict=True):
                i = place[tuple(h)]
                self.stats[i], self.lows[i] = stats, low


REQUEST = "chunk long, bucket int, histories int, ctx binary, w binary, n binary, lc binary, flags binary"
REQUEST_NAMES = ["chunk", "bucket", "histories", "ctx", "w", "n", "lc", "flags"]
#: kind 0: answers to a chunk; 1: how many n-grams were seen how often; 2: the model; 3: sums of a share; 4: a chunk that needs them; 5: the whole sums
ANSWER = "kind int, chunk long, bucket int, histories int, ctx binary, w binary, n binary, lc binary, flags binary, c binary, stats binary, low binary, h array<long>, sums array<long>, low_sum double"


def _runs(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Runs of bytes as binaries."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())]).cast(pa.binary())


def _varint_runs(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Runs of numbers as varints."""
    data, size = varints(values)
    return _runs(data, np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[at])


def _steps(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Differences from the value before, whole values at the heads."""
    out = np.diff(values, prepend=0)
    out[heads] = values[heads]
    return out


def _summed(steps: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The inverse of _steps for runs of the sizes."""
    total = np.concatenate([[0], np.cumsum(steps)])
    return total[1:] - np.repeat(total[np.cumsum(size) - size], size)


def _rows(bucket: np.ndarray, at: np.ndarray, ids: list[np.ndarray], length: np.ndarray, word: np.ndarray, n: np.ndarray, low: np.ndarray, flags: np.ndarray) -> pa.Table:
    """Records (a history, its followers) as varints, records ``at[i]`` to ``at[i + 1]`` in row i."""
    place = np.concatenate([[0], np.cumsum(length)])
    ctx = np.column_stack([_steps(ids[0], at[:-1]), *ids[1:], length])
    entries = place[at]
    return pa.table({
        "bucket": pa.array(bucket, pa.int32()), "histories": pa.array(np.diff(at), pa.int32()), "ctx": _varint_runs(ctx.ravel(), at * ctx.shape[1]),
        "w": _varint_runs(_steps(word, place[:-1][length > 0]), entries), "n": _varint_runs(n, entries), "lc": _varint_runs(low, entries), "flags": _varint_runs(flags, at),
    })


def _bucket(order: int, weigh, model: bool):
    """The function of a bucket's requests (the rows of a model count as requests): answers, and the model's row."""

    def f(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        numbers = lambda c: from_varints(utf8(t.column(c))[0])
        size = t.column("histories").to_numpy().astype(np.int64)
        ctx = numbers("ctx").reshape(-1, order)
        ids, length = [_summed(ctx[:, 0], size), *(ctx[:, i] for i in range(1, order - 1))], ctx[:, -1]
        row = np.repeat(np.arange(len(size)), size)
        word, n, low, flags = _summed(numbers("w"), length), numbers("n"), numbers("lc"), numbers("flags")
        history = ids[0]
        for x in ids[1:]:
            history = ranked(history)[2] * (int(x.max(initial=0)) + 1) + x
        known, _, of = ranked(history)
        record = np.repeat(np.arange(len(length)), length)
        entry = of[record]
        pair, first, place = ranked(entry * (int(word.max(initial=0)) + 1) + word)
        c = np.bincount(place, weights=n, minlength=len(pair)).astype(np.int64)
        seen = np.flatnonzero(c > 0)
        cs, hs = c[seen], entry[first[seen]]
        stats = np.zeros((len(known), K + 1), np.int64)
        few = cs <= K
        stats[:, :K] = np.bincount(hs[few] * K + cs[few] - 1, minlength=len(known) * K).reshape(-1, K)
        stats[:, K] = np.bincount(hs[~few], weights=cs[~few], minlength=len(known))
        lows = np.bincount(hs, weights=weigh(low[first[seen]]), minlength=len(known))
        split = flags >= 4
        found = c[place]
        misses = np.bincount(record, weights=found == 0, minlength=len(length)) > 0
        given = stats[of]
        given[split] = 0
        low_given = np.where(~split & (misses | (flags & 1 > 0)), lows[of], 0.0)
        at = np.concatenate([[0], np.cumsum(size)])
        entries = np.concatenate([[0], np.cumsum(length)])[at]
        asked = pa.table({
            "chunk": t.column("chunk"), "bucket": t.column("bucket"),
            "c": _varint_runs(found, entries), "stats": _varint_runs(given.ravel(), at * (K + 1)), "low": _runs(low_given.view(np.uint8), at * 8),
        })
        asked = asked.filter(pc.greater_equal(asked.column("chunk"), 0))
        parts = [asked.append_column("kind", pa.array(np.zeros(asked.num_rows), pa.int32()))]
        hist = np.bincount(np.minimum(cs, K + 2), minlength=K + 3)[: K + 2]
        parts.append(pa.table({"kind": pa.array([1], pa.int32()), "bucket": t.column("bucket")[:1], "sums": pa.array([hist.tolist()], pa.list_(pa.int64()))}))
        if model and len(seen):  # the pairs are in the order of histories and words
            head = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
            of_head = record[first[seen[head]]]
            counts = np.diff(np.append(head, len(hs)))
            table = _rows(t.column("bucket")[:1].to_numpy(), np.array([0, len(head)]), [x[of_head] for x in ids], counts, word[first[seen]], cs, low[first[seen]], flags[of_head] & ~1)
            parts.append(table.append_column("kind", pa.array([2], pa.int32())).append_column("chunk", pa.array([-1], pa.int64())))
        if split.any():
            own = np.unique(of[split], return_index=True)[1]
            some = np.flatnonzero(split)[own]
            h = lambda at: pa.array(np.column_stack([x[at] for x in ids]).tolist(), pa.list_(pa.int64()))
            parts.append(pa.table({"kind": pa.array(np.full(len(some), 3), pa.int32()), "h": h(some), "sums": pa.array(stats[of[some]].tolist(), pa.list_(pa.int64())), "low_sum": pa.array(lows[of[some]])}))
            asker = t.column("chunk").to_numpy()[row]
            need = np.flatnonzero(split & (asker >= 0))
            parts.append(pa.table({"kind": pa.array(np.full(len(need), 4), pa.int32()), "chunk": pa.array(asker[need]), "h": h(need)}))
        out = pa.concat_tables(parts, promote_options="permissive")
        columns = [out.column(k).cast(kind) if k in out.column_names else pa.nulls(out.num_rows, kind) for k, kind in zip(ANSWER_SCHEMA.names, ANSWER_SCHEMA.types, strict=True)]
        return pa.table(columns, ANSWER_SCHEMA.names)

    return f


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "double": pa.float64()}
ANSWER_SCHEMA = pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in ANSWER.split(", ")])
REPLY = ["order", "kind", "chunk", "bucket", "c", "stats", "low", "h", "sums", "low_sum"]


# Levels over all chunks


@dataclass
class Model:
    """``vocabulary(word, id, count)`` and for each order from 2 on ``tables[order - 2]``: n-gram counts by bucket of the
    history, packed; ``d``: the discounts of each order. ``total``, ``kinds``, ``ends``: training tokens, distinct ones, texts."""

    vocabulary: DataFrame
    tables: list[DataFrame]
    d: list[np.ndarray]
    total: int
    kinds: int
    ends: int
    buckets: int

    @property
    def whole(self) -> float:
        return self.total + ADD * (self.kinds + 1)

    def plain(self) -> Model:
        """Without tables, for tasks."""
        return Model(None, [], list(self.d), self.total, self.kinds, self.ends, self.buckets)


def _levels(row: dict, replies: pa.Table | None, m: Model, upto: int, answered: int, wave: tuple[int, int] = (0, 1)) -> tuple[Unit, list[Level]]:
    """The unit's levels up to an order, with the answers up to another."""
    unit, levels = Unit(row, m.ends), []
    for order in range(2, upto + 1):
        levels.append(Level(unit, levels[-1] if levels else None))
        levels[-1].ask(m.buckets, wave if order > answered else (0, 1))
        if order <= answered:
            levels[-1].answered(replies.filter(pc.equal(replies.column("order"), order)))
    return unit, levels


def _first_row(t: pa.Table) -> dict:
    t = t.combine_chunks()
    return {c: t.column(c)[0] for c in t.column_names}


def _ask(units: DataFrame, replies: DataFrame | None, m: Model, order: int, wave: tuple[int, int]) -> DataFrame:
    """Requests of all chunks for n-grams of an order."""
    m = m.plain()
    empty = pa.table({k: pa.array([], x) for k, x in zip(REQUEST_NAMES, [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5], strict=True)})

    def asked(row: dict, got: pa.Table | None) -> pa.Table:
        _, levels = _levels(row, got, m, order, order - 1, wave)
        return levels[-1].requests(row["chunk"].as_py())

    if replies is None:

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield from asked(_first_row(pa.Table.from_batches([batch.slice(i, 1)])), None).to_batches()

        return units.mapInArrow(each, REQUEST)
    counts = replies.where("kind = 0").select("order", "kind", "chunk", "bucket", "c")
    return units.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(lambda a, b: asked(_first_row(a), b) if a.num_rows else empty, REQUEST)


def _answer(units: DataFrame, replies: DataFrame | None, m: Model, order: int, keep: Scratch, waves: int, given: DataFrame | None, model: bool) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(replies to chunks, the model's rows, numbers of n-grams seen 0..K+1 times) of an order. ``given``: rows of a model."""
    lower = m.d[-1] if order > 2 else None
    weigh = (lambda c: c + ADD) if order == 2 else (lambda c: discounted(c, lower))
    f, tables = _bucket(order, weigh, model), []
    if order == 2:  # few bytes, and little else is stored yet
        waves = 1
    for w in range(waves):
        asked = _ask(units, replies, m, order, (w, waves))
        if given is not None:
            asked = asked.union(given.where(F.col("bucket") % waves == w).select(*REQUEST_NAMES))
        tables.append(keep.stored(asked.groupBy("bucket").applyInArrow(f, ANSWER), "kind"))
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.union(t)
    columns = [F.lit(order).alias("order") if c == "order" else F.col(c) for c in REPLY]
    out = rows.where("kind = 0").select(*columns)
    if rows.where("kind = 4").limit(1).count():
        totals = rows.where("kind = 3").select("h", F.posexplode("sums"), "low_sum")
        totals = totals.groupBy("h", "pos").agg(F.sum("col").alias("v"), F.sum("low_sum").alias("low_sum"))
        totals = totals.groupBy("h").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x.v).alias("sums"), F.min("low_sum").alias("low_sum"))
        wanted = rows.where("kind = 4").select("chunk", "h").distinct().join(totals, "h")
        out = out.unionByName(wanted.select(F.lit(order).alias("order"), F.lit(5).alias("kind"), "chunk", "h", "sums", "low_sum"), allowMissingColumns=True)
    hist = {r.pos: r.n for r in rows.where("kind = 1").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect()}
    return out, rows.where("kind = 2"), np.array([hist.get(i, 0) if i else 0 for i in range(K + 2)], float)


RESULT = "n_tokens long, n_known long, base_score double, score double"


def _scored(units: DataFrame, replies: DataFrame, m: Model, order: int, key: str, kind: str) -> DataFrame:
    """``key, n_tokens, n_known, base_score, score`` of every document."""
    m, names = m.plain(), [key, "n_tokens", "n_known", "base_score", "score"]

    def logs(levels: list[Level], unit: Unit) -> tuple[np.ndarray, np.ndarray]:
        """Of each token the log10 of P(w), and of P(w|h)."""
        p = np.log10((unit.count[unit.token] + ADD) / m.whole)
        base, norm = p, None
        for level, d in zip(levels, m.d, strict=True):
            many = np.arange(1, K + 1)
            c = level.stats[:, :K] @ many + level.stats[:, K]
            mass = (level.stats[:, :K] @ (many * d[1:]) + level.stats[:, K]) / np.maximum(c, 1)
            scale = np.where(mass > c / (c + 1.0), c / (c + 1.0) / np.maximum(mass, 1e-300), 1.0)
            under = level.lows / m.whole if norm is None else level.lows * norm[level.shorter]
            backoff = np.where(c > 0, np.log10((1 - mass * scale) / np.maximum(1 - under, 1e-300)), 0.0)
            norm = scale / np.maximum(c, 1)
            with np.errstate(divide="ignore"):
                own = np.log10(norm[level.of] * discounted(level.c, d))
            p = np.where(level.c[level.node] > 0, own[level.node], backoff[level.of][level.node] + p)
        return base, p

    def score(documents: pa.Table, got: pa.Table) -> pa.Table:
        if not documents.num_rows:
            return pa.table({k: pa.array([], x) for k, x in zip(names, [documents.schema.field("keys").type.value_type, pa.int64(), pa.int64(), pa.float64(), pa.float64()], strict=True)})
        unit, levels = _levels(_first_row(documents), got, m, order, order)
        base, full = logs(levels, unit)
        add = lambda x: np.add.reduceat(x, unit.at[:-1])
        return pa.table([unit.keys, pa.array(unit.n), pa.array(add((unit.count[unit.token] > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(full))], names)

    return units.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(score, f"`{key}` {kind}, {RESULT}")


def _run(docs: DataFrame, train: Column, known: Model | None, keep: Scratch, order: int, chunk_bytes: int, waves: int, model: bool, key: str, text: str, score: bool) -> tuple[list[DataFrame], Model]:
    """(the scores by wave, the model)."""
    kind = docs.schema[key].dataType.simpleString()
    chunk = keep.stored(chunk_table(docs, train, chunk_bytes, key, text))
    words = dictionary(chunk)
    if known:
        m, vocabulary_table = Model(known.vocabulary, [], [], known.total, known.kinds, known.ends, known.buckets), known.vocabulary
    else:
        vocabulary_table, n, v = vocabulary(words, keep)
        ends = chunk.agg(F.sum(F.size(F.filter("train", lambda x: x)))).first()[0] or 0
        m = Model(vocabulary_table, [], [], n + ends, v + (ends > 0), ends, max(1, -(-(n + ends) // BUCKET)))
    units = keep.stored(unit_table(chunk, words, vocabulary_table))
    keep.drop(chunk)
    replies = None
    for i in range(2, order + 1):
        got, table, hist = _answer(units, replies, m, i, keep, waves, known.tables[i - 2] if known else None, model)
        m.d.append(known.d[i - 2] if known else discounts(hist))
        m.tables.append(table)
        replies = got if replies is None else replies.union(got)
    own = [F.pmod(F.xxhash64("chunk"), F.lit(waves)) == w for w in range(waves)] if score else []
    return [_scored(units.where(x), replies.where(x), m, order, key, kind) for x in own], m


def _results(out: list[DataFrame], m: Model, key: str) -> DataFrame:
    parts = [cut(x.select(key, "n_tokens", "n_known", F.lit(m.total).cast("long").alias("train_tokens"), "base_score", "score")) for x in out]
    return functools.reduce(DataFrame.union, parts)


def score_documents(docs: DataFrame, train: Column, order: int = 3, chunk_bytes: int = 6 << 20, waves: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, n_known, train_tokens, base_score, score``: log10 probabilities under a model of the documents
    where ``train`` is true (null is false), for every row.

    Tokens are the words and one end; a null or empty text is its end alone. A document's first histories are its
    beginning. Without training documents every token has the unknown word's probability 1. Repeated rows
    count and are scored each; a null key stays null. Other columns aren't read. An empty table gives an empty one.
    A task holds a chunk of ``chunk_bytes`` (or one longer text) or the n-grams of a bucket; ``waves``: in so many
    turns buckets are filled and chunks scored, which bounds the shuffled bytes on disk at a time. The tables are removed at the end.
    """
    with Scratch(docs.sparkSession) as keep:
        out, m = _run(docs, train, None, keep, order, chunk_bytes, waves, False, key, text, True)
        return _results(out, m, key)


def fit(docs: DataFrame, keep: Scratch, order: int = 3, chunk_bytes: int = 6 << 20, waves: int = 3, key: str = "doc_id", text: str = "text") -> Model:
    """A model of all texts; its tables live as long as ``keep``."""
    return _run(docs, F.lit(True), None, keep, order, chunk_bytes, waves, True, key, text, False)[1]


def score(docs: DataFrame, model: Model, chunk_bytes: int = 6 << 20, waves: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Like ``score_documents`` for another corpus under a fitted model: requests meet the model's tables by bucket."""
    with Scratch(docs.sparkSession) as keep:
        out, m = _run(docs, F.lit(False), model, keep, len(model.d) + 1, chunk_bytes, waves, False, key, text, True)
        return _results(out, m, key)
