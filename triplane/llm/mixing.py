"""Mixing to target weights with soft membership: domain posteriors of a classifier fitted on a labelled table,
then document rates by distributed projected-gradient least squares."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIERS, U64, Words, arrow_map, chunks, cut, utf8
from .common import mix as mix64


@dataclass(frozen=True)
class Classifier:
    """Softmax regression on what a document holds: the place of each used bucket (else -1), and weights (places and
    one for all documents x domains)."""

    domains: tuple[str, ...]
    place: np.ndarray
    weights: np.ndarray

    def posteriors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(words, posteriors) of each text."""
        sizes, out = [np.zeros(0, np.int64)], [np.zeros((0, len(self.domains)))]
        for n, found in _words(column):
            doc, bucket = _present(n, found, len(self.place), self.place >= 0)
            logs = np.stack([w[-1] + np.bincount(doc, weights=w[self.place[bucket]], minlength=len(n)) for w in self.weights.T])
            p = np.exp(logs - logs.max(0))
            out.append((p / p.sum(0)).T)
            sizes.append(n)
        return np.concatenate(sizes), np.concatenate(out)


#: Kinds of bytes for shapes: capitals, other letters, digits; the rest stays.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 65, 97, 97, 48
PREFIX = 6


def _words(column: pa.Array) -> Iterator[tuple[np.ndarray, list[Words]]]:
    """Of runs of documents the number of words, and the words, their shapes (runs of a kind of letter or digit as
    one) and their first ``PREFIX`` bytes."""
    data, offsets = utf8(column)
    for i, j in chunks(offsets):
        own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        words = Words(own, at)
        kind = _KIND[own]
        run = np.zeros(len(kind), bool)
        run[1:] = (kind[1:] == kind[:-1]) & ((kind[1:] == 65) | (kind[1:] == 97) | (kind[1:] == 48))
        run[at[:-1][at[:-1] < len(kind)]] = False
        edge = np.zeros(len(own) + 1, np.int8)
        edge[words.start + np.minimum(PREFIX, words.end - words.start)] += 1
        np.subtract.at(edge, words.end, 1)
        rest = np.cumsum(edge[:-1], dtype=np.int8) > 0
        part = lambda bytes_, keep, lower: Words(bytes_[keep], np.concatenate([[0], np.cumsum(keep)])[at], lower=lower)
        yield np.diff(words.at), [words, part(kind, ~run, False), part(own, ~rest, True)]


def _present(n: np.ndarray, found: list[Words], buckets: int, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, bucket) pairs: a bucket for what a document holds, another for what it holds twice or more."""
    docs, out = [], []
    for k, words in enumerate(found):
        doc = np.repeat(np.arange(len(n)), np.diff(words.at))
        once, twice = (mix64(words.hash ^ MULTIPLIERS[2 * k + x]) % U64(buckets) for x in (0, 1))
        if use is not None:
            some = use[once] | use[twice]
            doc, once, twice = doc[some], once[some], twice[some]
        pair, first, count = np.unique(doc * buckets + once.astype(np.int64), return_index=True, return_counts=True)
        again = first[count > 1]
        docs += [pair // buckets, doc[again]]
        out += [pair % buckets, twice[again].astype(np.int64)]
    pair = np.unique(np.concatenate(docs) * buckets + np.concatenate(out))
    if use is not None:
        pair = pair[use[pair % buckets]]
    return pair // buckets, pair % buckets


def fit(
    docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...], sample: int = 10_000, buckets: int = 1 << 18, features: int = 1024, evidence: float = 12.0, ridge: float = 0.5,
    key: str = "doc_id", text: str = "text",
) -> Classifier:
    """Softmax regression fitted to ``labelled(key, domain)`` rows of ``domains``, at most ``sample``, those with the
    least hash of the key; few enough that their keys are broadcast. Its ``features`` are the buckets that depend most
    on the domain (``evidence``: least likelihood ratio). The driver gets the buckets' sums, then the sample's features."""
    few = labelled.select(key, "domain").where(F.col(key).isNotNull() & F.col("domain").isin(*domains)).distinct().orderBy(F.xxhash64(key), "domain").limit(sample)

    def kinds(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[Words]]]:
        names, at = np.array([domains.index(x) for x in batch.column(1).to_pylist()]), 0
        for n, found in _words(batch.column(0)):
            yield names[at : at + len(n)], n, found
            at += len(n)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = np.zeros((len(domains), buckets + 1), np.int64)
        for kind, n, found in kinds(batch):
            doc, bucket = _present(n, found, buckets)
            total += np.bincount(kind[doc] * (buckets + 1) + bucket, minlength=total.size).reshape(total.shape)
            total[:, buckets] += np.bincount(kind, minlength=len(domains))  # the last column counts documents
        d, b = np.nonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(d.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[d, b])], ["d", "b", "n"])

    rows = docs.select(key, text).join(F.broadcast(few), key).select(text, "domain")
    of = [F.sum(F.when(F.col("d") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(domains))]
    # what is in fewer than 4 documents can't have the evidence
    counted = arrow_map(rows, count, "d int, b int, n long").groupBy("b").agg(*of, F.sum("n").alias("n")).where((F.col("n") > 3) | (F.col("b") == buckets)).toPandas()
    counts = np.zeros((len(domains), buckets + 1))
    counts[:, counted["b"].to_numpy(int)] = counted[[f"n{i}" for i in range(len(domains))]].to_numpy(float).T
    n_docs = counts[:, buckets]
    place = _features(counts[:, :buckets], n_docs, features, evidence)
    if not (place >= 0).any():
        return _regression(domains, place, np.zeros((0, 1), np.float32), np.zeros(0, int), n_docs, ridge)

    def held(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, names = [], []
        for kind, n, found in kinds(batch):
            doc, bucket = _present(n, found, buckets, place >= 0)
            out += np.split(place[bucket], np.searchsorted(doc, np.arange(1, len(n))))
            names.append(kind)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(names).astype(np.int32)), pa.array(out, pa.list_(pa.int64()))], ["d", "places"])

    got = arrow_map(rows, held, "d int, places array<long>").toPandas()
    x = np.zeros((len(got), int(place.max()) + 2), np.float32)
    for i, p in enumerate(got["places"]):
        x[i, p] = 1
    return _regression(domains, place, x, got["d"].to_numpy(int), n_docs, ridge)


def _features(counts: np.ndarray, n_docs: np.ndarray, features: int, evidence: float) -> np.ndarray:
    """Places of the buckets used, from the documents of each domain that hold each bucket, and all of each domain."""
    n = n_docs[:, None]
    rate = counts.sum(0) / max(n_docs.sum(), 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        held = np.where(counts > 0, counts * np.log(counts / (n * rate)), 0.0)
        lacked = np.where(n > counts, (n - counts) * np.log((n - counts) / (n * (1 - rate))), 0.0)
    ratio = 2 * (held + lacked).sum(0)
    best = np.argsort(-ratio, kind="stable")[:features]
    best = best[ratio[best] >= evidence]
    place = np.full(counts.shape[1], -1)
    place[best] = np.arange(len(best))
    return place


def _regression(domains: tuple[str, ...], place: np.ndarray, x: np.ndarray, y: np.ndarray, n_docs: np.ndarray, ridge: float, steps: int = 1000) -> Classifier:
    """Penalised maximum likelihood. Half of x'x bounds the curvature, so each step of it is an ascent. Without
    features the weights are the logarithms of the domains' shares."""
    weights = np.zeros((x.shape[1], len(domains)))
    weights[-1] = np.log((n_docs + 1) / (n_docs.sum() + len(domains)))
    if len(x):
        x[:, -1] = 1
        target, penalty = np.eye(len(domains))[y], np.full((x.shape[1], 1), ridge)
        penalty[-1] = 1e-3
        step = np.linalg.inv(0.5 * (x.T @ x).astype(float) + np.diag(penalty[:, 0]))
        ahead, speed = weights, 1.0
        for _ in range(steps):  # with momentum, started anew where it points downhill
            p = x @ ahead.astype(np.float32)
            p = np.exp(p - p.max(1, keepdims=True))
            new = ahead + step @ (x.T @ (target - p / p.sum(1, keepdims=True)).astype(np.float32) - penalty * ahead)
            move = new - weights
            speed, before = (1.0, 1.0) if ((ahead - new) * move).sum() > 0 else ((1 + np.sqrt(1 + 4 * speed * speed)) / 2, speed)
            weights, ahead = new, new + (before - 1) / speed * move
            if np.abs(move).max() < 1e-5:
                break
    return Classifier(domains, place, weights)


def _rates(p: np.ndarray, price: np.ndarray) -> np.ndarray:
    """Rate 1 moved against the price of each domain and projected on what is not negative."""
    return np.maximum(0.0, 1.0 - p @ price)


def _sums(n: np.ndarray, p: np.ndarray, price: np.ndarray) -> np.ndarray:
    """Domain totals of the rates, their squared length in the token metric, and domain x domain sums of the rows whose rate isn't 0."""
    rate = _rates(p, price)
    return np.concatenate([(n * rate) @ p, [n @ (rate * rate)], ((p * (n * (rate > 0))[:, None]).T @ p).ravel()])


def solve(totals: Callable[[np.ndarray], np.ndarray], wanted: np.ndarray, steps: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """(price, totals of its rates, whether it is the optimum) of the least-squares problem in ``mix``.

    The rates' squared distance from 1 counts with a tiny weight, so the unknown is one price a domain. A step of
    projected gradient is scaled by the inverse of the domain x domain sums, so a rare domain moves as
    fast as others, and is halved until the dual improves. ``totals``: a pass, giving ``_sums`` of all rows."""
    width = len(wanted)
    price = np.zeros(width)
    scale = max(wanted.sum(), 1e-300)
    b = wanted / scale

    def at(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        s = totals(x) / scale
        return 0.5 * tiny * (x @ x) + 0.5 * s[width] + x @ b, tiny * x - s[:width] + b, s[width + 1 :].reshape(width, width), s[:width]

    tiny = 0.0
    now = at(price)
    tiny = 1e-9 * max(float(np.linalg.eigvalsh(now[2]).max()), 1e-300)
    least = 0.1 * tolerance * np.maximum(b, 1e-3 * b[b > 0].min() if (b > 0).any() else 1.0)
    length, move = 1.0, None
    for _ in range(steps):
        value, slope, square, reached = now
        if (np.abs(slope) <= least).all():
            return price, reached * scale, True
        if move is None:
            move = -np.linalg.solve(square + tiny * np.eye(width), slope)
        then = at(price + length * move)
        if then[0] <= value + 1e-4 * length * (move @ slope) or np.abs(then[1]).max() < 0.5 * np.abs(slope).max():
            price, now, length, move = price + length * move, then, 1.0, None
        else:
            length *= 0.5
    return price, now[3] * scale, bool((np.abs(now[1]) <= least).all())


@dataclass(frozen=True)
class Report:
    """Expected tokens of each domain: wanted, and reached by the rates; ``optimal``: no rates come nearer."""

    domains: tuple[str, ...]
    wanted: np.ndarray
    reached: np.ndarray
    optimal: bool

    def met(self, tolerance: float) -> bool:
        return bool((np.abs(self.reached - self.wanted) <= tolerance * self.wanted).all())


def rated(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total_tokens: float | None = None, steps: int = 60, tolerance: float = 1e-3,
    carry: tuple[str, ...] = (), key: str = "doc_id", text: str = "text", **fit_options,
) -> tuple[DataFrame, Report]:
    """``mix`` and what it reaches; the columns ``carry`` of ``docs`` come as a struct ``carried``."""
    domains = tuple(sorted(targets))
    width = len(domains)
    model = fit(docs, labelled, domains, key=key, text=text, **fit_options)
    kind = docs.schema[key].dataType.simpleString()

    def lists(p: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * width, pa.int32()), pa.array(p.ravel()))

    def member(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, p = model.posteriors(batch.column(0))
        return pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)), lists(p)], ["n_tokens", "posterior"])

    rows = cut(arrow_map(docs.select(text), member, "n_tokens long, posterior array<double>"))

    def totals(f) -> np.ndarray:
        """Sum over all rows of the numbers that f makes of a batch's tokens and posteriors."""

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            sums = f(b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(b.num_rows, width))
            return pa.RecordBatch.from_arrays([pa.array([sums.ravel()], pa.list_(pa.float64()))], ["x"])

        sums = arrow_map(rows, each, "x array<double>").select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("v")).collect()
        return np.array([r.v for r in sorted(sums, key=lambda r: r.pos)])

    price = np.zeros(width)
    first = totals(lambda n, p: n @ p)
    wanted = np.array([targets[k] for k in domains], float) / sum(targets.values())
    wanted *= total_tokens if total_tokens is not None else first.sum()
    report = Report(domains, wanted, first if len(first) else np.zeros(width), True)
    if len(first) and first.sum() > 0:
        price, reached, best = solve(lambda x: totals(lambda n, p: _sums(n, p, x)), wanted, steps, tolerance)
        report = Report(domains, wanted, reached, best)

    rows = docs.select(key, text, *([F.struct(*carry).alias("carried")] if carry else []))
    carried = rows.columns[2:]

    def rate(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, p = model.posteriors(batch.column(1))
        names = pa.array([domains[i] for i in p.argmax(1)], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), names, lists(p), pa.array(_rates(p, price)), *batch.columns[2:]], [key, "n_tokens", "domain", "posterior", "rate", *carried])

    schema = f"`{key}` {kind}, n_tokens long, domain string, posterior array<double>, rate double" + "".join(f", carried {rows.schema[c].dataType.simpleString()}" for c in carried)
    return arrow_map(rows, rate, schema), report


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], tolerance: float = 1e-3, **options) -> DataFrame:
    """``key, n_tokens, domain, posterior, rate`` (and ``carried``): a nonnegative expected number of copies for each row.

    ``labelled(key, domain)``; ``targets``: weights of the domains (scaled to sum 1) of ``total_tokens``, by
    default the tokens there are. The rates minimise the squared error of the expected domain totals,
    sum of rate x tokens x posterior, and of these are the closest to 1: projected gradient in the token metric, scaled
    by the inverse of a small domain x domain sum (``solve``), until each domain is within ``tolerance`` of its own
    target. A step costs one pass over the posteriors; the driver sees domain x domain sums. ``domain``: the likeliest,
    ties to the first in alphabetical order. Null texts and texts without words have 0 tokens and weigh nothing,
    whatever their rate. Without labelled rows all posteriors are equal. Repeated rows count
    each; a null key stays null. Targets that can't be reached are met as closely as rates allow, and a warning gives
    what each domain reaches; so does one if ``steps`` passes don't suffice (``rated`` returns these figures too).
    Other columns aren't read. An empty table gives an empty one.
    """
    out, report = rated(docs, labelled, targets, tolerance=tolerance, **options)
    if not report.optimal or not report.met(tolerance):
        found = ", ".join(f"{k} {got:.6g} of {want:.6g}" for k, got, want in zip(report.domains, report.reached, report.wanted, strict=True))
        warnings.warn(f"{'targets out of reach' if report.optimal else 'rates not settled'}, tokens by domain: {found}", stacklevel=2)
    return out
