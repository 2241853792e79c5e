"""Repeated byte strings by prefix-free parsing: a byte goes if a string of ``length`` bytes over it also
starts earlier.

1. Parse. A rolling hash of ``trigger`` bytes cuts texts into phrases: a place is a trigger if its hash is the
   least of those inside some ``length``-byte string. So every such string holds a trigger (no text is free of
   phrases), and equal strings hold equal triggers.
2. Dictionary. A trigger with all that strings through it can reach (its neighbourhood) is keyed by both hashes;
   one row of each neighbourhood, its first place, stands for all copies. Triggers that occur once go.
3. Suffix order. For triggers with several neighbourhoods, the phrase ends left of the trigger and the parse
   right of it are sorted with their common prefix lengths; both orders together rank every ``length``-byte
   string through the trigger, and equal ranks are equal strings.
4. The places found are merged by document and cut out.

A group too large for a task is ranked by hashes of its strings in a plain aggregation instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BYTE_CODE, MULTIPLIERS, U64, arrow_map, chunks, mix, powers, stored, utf8

CHUNK = 1 << 20


class Shape:
    """length: of a string that counts; trigger: bytes of a trigger (a power of two); reach: bytes of a
    neighbourhood on each side of the trigger."""

    def __init__(self, length: int, trigger: int) -> None:
        if not 1 <= trigger <= length or trigger & (trigger - 1):
            raise ValueError("trigger is a power of two of at most length")
        self.length, self.trigger, self.reach = length, trigger, length - trigger
        self.whole = length + self.reach


def rolled(codes: np.ndarray, n: int, start: dict[int, np.ndarray]) -> np.ndarray:
    """Hash of the n codes from each place on (n a power of two), by doubling; zeros beyond the end."""
    if n not in start:
        half = rolled(codes, n // 2, start)
        ahead = np.zeros_like(half)
        ahead[: len(half) - n // 2] = half[n // 2 :]
        start[n] = mix(half * MULTIPLIERS[n.bit_length()] + ahead)
    return start[n]


def any_length(codes: np.ndarray, n: int, at: np.ndarray, start: dict[int, np.ndarray]) -> np.ndarray:
    """Hash of the n codes from each of the places ``at``, put together from powers of two."""
    out, done, k = np.zeros(len(at), U64), 0, 0
    for bit in reversed(range(n.bit_length())):
        if n >> bit & 1:
            out = mix(out * MULTIPLIERS[20 + k] + rolled(codes, 1 << bit, start)[at + done])
            done, k = done + (1 << bit), k + 1
    return out


def slid(values: np.ndarray, n: int, f: np.ufunc) -> np.ndarray:
    """f over the n values from each place on; the last n-1 places stay as they are."""
    out, done = values.copy(), 1
    while done < n:
        step = min(done, n - done)
        out[:-step] = f(out[:-step], out[step:].copy())
        done += step
    return out


def triggers(data: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """(document, place, trigger hash, neighbourhood hash) of all triggers of some documents.

    Texts are laid out with a gap of zeros before each and at the end, so nothing crosses them."""
    sizes = np.diff(offsets)
    use = np.flatnonzero(sizes >= shape.length)
    if not len(use):
        return tuple(np.zeros(0, x) for x in (np.int64, np.int64, U64, U64))
    gap = shape.whole
    heads = np.concatenate([[0], np.cumsum(sizes[use] + gap)])[:-1] + gap
    codes = np.zeros(int(sizes[use].sum()) + gap * (len(use) + 1), U64)
    for h, d in zip(heads.tolist(), use.tolist(), strict=True):
        codes[h : h + sizes[d]] = BYTE_CODE[data[offsets[d] : offsets[d + 1]]]
    start: dict[int, np.ndarray] = {1: codes}
    h = rolled(codes, shape.trigger, start)
    valid = np.zeros(len(codes) + 1, np.int8)
    valid[heads] += 1
    valid[heads + sizes[use] - shape.length + 1] -= 1
    starts = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    span = shape.reach + 1
    least = np.where(starts, slid(h, span, np.minimum), U64(0))
    back = slid(least[::-1], span, np.maximum)[::-1]
    at = np.flatnonzero((back == h) & (h > 0) & (codes > 0))
    doc = np.searchsorted(heads, at, side="right") - 1
    return use[doc], at - heads[doc], h[at], any_length(codes, shape.whole, at - shape.reach, start)


def _kept_order(key: np.ndarray, area: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by neighbourhood and place, without rows that repeat another (a repeated document); which are copies."""
    order = np.lexsort((place, doc, area, key))
    k, a, d, p = key[order], area[order], doc[order], place[order]
    same = (k[1:] == k[:-1]) & (a[1:] == a[:-1])
    new = np.concatenate([[True], ~(same & (d[1:] == d[:-1]) & (p[1:] == p[:-1]))])
    return order[new], np.concatenate([[False], same])[new]


def trigger_rows(docs: DataFrame, shape: Shape, key: str, text: str) -> DataFrame:
    """``trigger, area, doc, place, again``. In each batch only the first place of a neighbourhood takes
    part in the search; the others are known to be copies (again) and are dealt by their own place."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        data, offsets = utf8(batch.column(1))
        ids = batch.column(0).to_numpy().astype(np.int64)
        found = []
        for i, j in chunks(offsets, CHUNK):
            doc, place, h, area = triggers(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shape)
            found.append((ids[doc + i], place, h, area))
        doc, place, h, area = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(doc):
            return None
        order, again = _kept_order(h, area, doc, place)
        doc, place, h, area = doc[order], place[order], h[order], area[order]
        own = mix(doc.astype(U64) * MULTIPLIERS[30] + place.astype(U64))
        h = np.where(again, own, h)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(area.view(np.int64)), pa.array(doc), pa.array(place.astype(np.int32)), pa.array(again)], ["trigger", "area", "doc", "place", "again"])

    return arrow_map(docs.select(key, text).where(f"{key} IS NOT NULL"), each, "trigger long, area long, doc long, place int, again boolean")


def suffix_ranks(group: np.ndarray, areas: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows (trigger group, neighbourhood bytes): of the dictionary side (bytes left of the trigger, read
    leftwards) and of the parse side (the trigger and what follows) the sorted order and common prefix lengths."""

    def ordered(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = -(-side.shape[1] // 8) * 8
        wide = np.zeros((len(side), width), np.uint8)
        wide[:, : side.shape[1]] = side
        columns = wide.view(">u8").astype(U64)
        order = np.lexsort((*columns.T[::-1], group))
        g, rows = group[order], side[order]
        differ = rows[1:] != rows[:-1]
        common = np.where(differ.any(1), differ.argmax(1), side.shape[1])
        common[g[1:] != g[:-1]] = -1
        return order, common

    left, right = areas[:, : shape.reach][:, ::-1], areas[:, shape.reach :]
    return *ordered(np.ascontiguousarray(left)), *ordered(np.ascontiguousarray(right))


def repeated(group: np.ndarray, areas: np.ndarray, low: np.ndarray, high: np.ndarray, shape: Shape) -> np.ndarray:
    """Rows in document order -> rows x (reach + 1) flags: does the string that starts l bytes left of the
    trigger equal that of an earlier row? low, high: l of the strings that lie inside the document."""
    lorder, lcommon, rorder, rcommon = suffix_ranks(group, areas, shape)
    n, out = len(group), np.zeros((len(group), shape.reach + 1), bool)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for l in range(shape.reach + 1):
        inside = np.flatnonzero((low <= l) & (l <= high))
        if len(inside) < 2:
            continue
        left[lorder] = np.concatenate([[0], np.cumsum(lcommon < l)])
        right[rorder] = np.concatenate([[0], np.cumsum(rcommon < shape.length - l)])
        rank = left[inside] * n + right[inside]
        order = np.argsort(rank, kind="stable")
        later = np.concatenate([[False], rank[order[1:]] == rank[order[:-1]]])
        out[inside[order[later]], l] = True
    return out


def _ranges(flags: np.ndarray, doc: np.ndarray, place: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of runs of flags."""
    wide = np.zeros((len(flags), flags.shape[1] + 2), np.int8)
    wide[:, 1:-1] = flags
    step = np.diff(wide, axis=1)
    row, first = np.nonzero(step == 1)
    _, stop = np.nonzero(step == -1)
    return doc[row], place[row] - (stop - 1), place[row] - first + shape.length


def _squeezed(docs: DataFrame, key: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Texts as zstandard frames, which halves what a shuffle of them moves; the columns ``carry`` go along as
    one struct, so their names can't clash."""
    rows = docs.select(key, text, *([F.struct(*carry).alias("carried")] if carry else []))
    names = [key, "blob", *rows.columns[2:]]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=1)
        data, offsets = utf8(batch.column(1))
        blobs = [press.compress(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary()), *batch.columns[2:]], names)

    return arrow_map(rows, each, _columns(rows, key) + ", blob binary" + _columns(rows, *rows.columns[2:], lead=", "))


def _columns(df: DataFrame, *names: str, lead: str = "") -> str:
    return "".join(f"{lead if i == 0 else ', '}`{n}` {df.schema[n].dataType.simpleString()}" for i, n in enumerate(names))


def _text(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def neighbourhoods(blobs: DataFrame, wanted: DataFrame, shape: Shape, key: str) -> DataFrame:
    """``trigger, doc, place, low, high, bytes`` for the wanted ``trigger, doc, place``."""
    by_doc = wanted.groupBy(F.col("doc").alias(key)).agg(F.collect_set(F.struct("trigger", "place")).alias("at"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, blob, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            raw = np.frombuffer(_text(blob.as_py()), np.uint8)
            wide = np.zeros(len(raw) + 2 * shape.whole, np.uint8)
            wide[shape.whole : shape.whole + len(raw)] = raw
            trigger, place = (at.values.field(i).to_numpy() for i in (0, 1))
            place = place.astype(np.int64)
            inside = place + shape.trigger <= len(raw)  # else the key is another row's too
            trigger, place = trigger[inside], place[inside]
            areas = wide[(place + shape.whole - shape.reach)[:, None] + np.arange(shape.whole)]
            low = np.maximum(0, place + shape.length - len(raw))
            high = np.minimum(shape.reach, place)
            out.append((trigger, np.full(len(place), doc), place, low, high, areas))
        t, d, p, lo, hi, areas = (np.concatenate(x) for x in zip(*out, strict=True))
        flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(shape.whole), len(areas), [None, pa.py_buffer(np.ascontiguousarray(areas).tobytes())])
        return pa.RecordBatch.from_arrays(
            [pa.array(t), pa.array(d), pa.array(p.astype(np.int32)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), flat.cast(pa.binary())],
            ["trigger", "doc", "place", "low", "high", "bytes"],
        )

    return arrow_map(blobs.join(by_doc, key).select(key, "blob", "at"), each, "trigger long, doc long, place int, low int, high int, bytes binary")


RANGES = "doc long, start int, stop int"
BATCH_ROWS = 20_000


def ranked_ranges(areas: DataFrame, shape: Shape) -> DataFrame:
    """Byte ranges found by suffix order, for groups that fit a task."""
    rows = areas.repartition("trigger").sortWithinPartitions("trigger", "doc", "place")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def flush(table: pa.Table) -> pa.RecordBatch | None:
            if not table.num_rows:
                return None
            t, doc, place, low, high = (table.column(i).to_numpy() for i in range(5))
            data, _ = utf8(table.column(5))
            data = data.reshape(len(t), shape.whole)
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])])
            t, doc, place, low, high, data = (x[new] for x in (t, doc, place, low, high, data))  # repeated documents
            group = np.cumsum(np.concatenate([[0], t[1:] != t[:-1]]))
            flags = repeated(group, data, low, high, shape)
            d, a, b = _ranges(flags, doc, place.astype(np.int64), shape)
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["doc", "start", "stop"]) if len(d) else None

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < BATCH_ROWS:
                continue
            table = pa.Table.from_batches(held)
            t = table.column(0).to_numpy()
            last = int(np.searchsorted(t, t[-1]))  # the last group may go on
            if last and (out := flush(table.slice(0, last))) is not None:
                yield out
            held = table.slice(last).combine_chunks().to_batches()
            count = len(t) - last
        if held and (out := flush(pa.Table.from_batches(held))) is not None:
            yield out

    return rows.mapInArrow(each, RANGES)


def hashed_ranges(areas: DataFrame, shape: Shape) -> DataFrame:
    """Byte ranges for groups of any size: each string by two hashes, its first place by an aggregation."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, place, low, high = (batch.column(i).to_numpy().astype(np.int64) for i in range(1, 5))
        data, _ = utf8(batch.column(5))
        data = data.reshape(len(doc), shape.whole)
        scale = [powers(shape.length), mix(np.arange(shape.length, dtype=U64) + U64(7)) | U64(1)]
        out = []
        for l in range(shape.reach + 1):
            inside = (low <= l) & (l <= high)
            codes = BYTE_CODE[data[inside, shape.reach - l : shape.reach - l + shape.length]]
            out.append((*(mix((codes * s).sum(1, dtype=U64)).view(np.int64) for s in scale), doc[inside], place[inside] - l))
        h1, h2, d, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(d), pa.array(s.astype(np.int32))], ["h1", "h2", "doc", "start"])

    strings = arrow_map(areas, each, "h1 long, h2 long, doc long, start int")
    place = F.struct("doc", "start")
    first = strings.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    return strings.join(first, ["h1", "h2"]).where(place != F.col("first")).select("doc", "start", (F.col("start") + shape.length).alias("stop")).distinct()


def repeated_ranges(docs: DataFrame, length: int = 100, trigger: int = 32, max_group: int = 50_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, start, stop``: byte ranges (they overlap) of strings that start earlier in the corpus."""
    shape = Shape(length, trigger)
    rows = trigger_rows(docs, shape, key, text)
    of_trigger, of_area = W.partitionBy("trigger"), W.partitionBy("trigger", "area")
    seen = rows.withColumns({
        "first": F.min(F.struct("doc", "place")).over(of_area),
        "low": F.min("area").over(of_trigger), "high": F.max("area").over(of_trigger), "n": F.count(F.lit(1)).over(of_trigger),
    })
    first = F.col("first") == F.struct("doc", "place")
    seen = seen.withColumn("copy", F.col("again") | ~first).where("copy OR low <> high")
    seen = stored(seen.select(F.when(~F.col("copy"), F.col("trigger")).alias("trigger"), "doc", "place", "copy", (F.col("n") > max_group).alias("hot")))
    copies = seen.where("copy").select("doc", F.greatest(F.col("place") - shape.reach, F.lit(0)).alias("start"), (F.col("place") + length).alias("stop"))
    wanted, blobs = seen.where("NOT copy"), _squeezed(docs, key, text)
    areas = neighbourhoods(blobs, wanted.where("NOT hot").select("trigger", "doc", "place"), shape, key)
    out = copies.union(ranked_ranges(areas, shape))
    if wanted.where("hot").limit(1).count():
        out = out.union(hashed_ranges(neighbourhoods(blobs, wanted.where("hot").select("trigger", "doc", "place"), shape, key), shape))
    return out


def merged(starts: np.ndarray, stops: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal runs of the bytes covered, inside 0..size."""
    if not len(starts):
        return []
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, np.clip(starts, 0, size), 1)
    np.add.at(edge, np.clip(stops, 0, size), -1)
    inside = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
    step = np.diff(inside)
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))


def dedup(docs: DataFrame, with_text: bool = False, carry: tuple[str, ...] = (), key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row: ``key, n_bytes, n_removed, n_spans, kept_sha256``, then ``kept_text`` if asked for, then the
    columns of ``docs`` named in ``carry`` as a struct ``carried``.

    Strings are judged on the input, not on what is left. Null and empty texts have 0 bytes; texts shorter
    than ``length`` lose nothing. A row with a null key has no place in the order: it keeps all and removes
    nothing elsewhere. Repeated rows (equal key and text) are one document and all get its result. A cut
    inside a character leaves bytes that are no UTF-8; ``kept_text`` leaves out such torn bytes.
    Columns not named aren't read. An empty table gives an empty one.
    """
    ranges = repeated_ranges(docs, key=key, text=text, **options)
    by_doc = ranges.groupBy(F.col("doc").alias(key)).agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    blobs = _squeezed(docs, key, text, carry)
    carried = blobs.columns[2:]
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for blob, a, b in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
            raw = _text(blob.as_py())
            runs = merged(a.values.to_numpy(), b.values.to_numpy(), len(raw)) if a.is_valid else []
            kept, at = [], 0
            for x, y in runs:
                kept.append(raw[at:x])
                at = y
            rest = b"".join([*kept, raw[at:]])
            rows.append((len(raw), len(raw) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_text else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)][: len(results)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[4:]], [key, *results, *carried])

    schema = _columns(docs, key) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text + _columns(blobs, *carried, lead=", ")
    return arrow_map(blobs.join(by_doc, key, "left").select(key, "blob", "starts", "stops", *carried), each, schema)
