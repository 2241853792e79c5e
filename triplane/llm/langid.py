"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map

#: Letters keep their bytes, whatever else is between words becomes one space.
_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def grams(text: str) -> np.ndarray:
    """The 1- to 3-byte grams of the lower-cased letters as numbers; none spans a word gap."""
    raw = _KEEP[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    gap = raw == 32
    raw = raw[~(gap & np.concatenate([[False], gap[:-1]]))].astype(np.uint32)
    ones, gap = raw[raw != 32], raw == 32
    twos = (raw[:-1] << np.uint32(8)) | raw[1:]
    threes = ((raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:])[~gap[1:-1]] if len(raw) > 2 else raw[:0]
    return np.concatenate([ones, twos, threes])


def ranked(values: np.ndarray, top: int) -> np.ndarray:
    """The most frequent values, most frequent first, ties by value."""
    unique, counts = np.unique(values, return_counts=True)
    return unique[np.lexsort((unique, -counts))][:top]


@dataclass(frozen=True)
class Profiles:
    """For each language its n-grams in ascending order with their ranks."""

    top: int
    langs: tuple[str, ...]
    grams: tuple[np.ndarray, ...]
    ranks: tuple[np.ndarray, ...]

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language, a gram that its profile lacks counts ``top``; 0 to 1."""
        places, out = np.arange(len(own)), []
        for known, rank in zip(self.grams, self.ranks, strict=True):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            out.append(np.where(known[at] == own, np.abs(rank[at] - places), self.top).sum())
        return np.array(out) / max(1, len(own) * self.top)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not any(map(str.isalpha, text)) or not self.langs:
            return "und", 0.0
        own = ranked(grams(text), self.top)
        if not len(own):
            return "und", 0.0
        d = self.distances(own)
        first = int(np.argmin(d))
        second = np.partition(d, 1)[1] if len(d) > 1 else 1.0
        return self.langs[first], float((second - d[first]) / second) if second > 0 else 0.0


def learn(docs: DataFrame, top: int = 400, text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles from all texts with a language (a null text or language teaches nothing). Each batch counts its
    grams by language first, each partition keeps the ``top`` of a language, and so many reach the driver."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
        out = []
        for k in sorted(set(langs)):
            own = [grams(t) for t, x in zip(texts, langs, strict=True) if x == k]
            out.append((k, *np.unique(np.concatenate(own), return_counts=True)))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, u, _ in out for _ in range(len(u))], pa.string()),
                pa.array(np.concatenate([u for _, u, _ in out]).astype(np.int32)),
                pa.array(np.concatenate([n for _, _, n in out]).astype(np.int64)),
            ],
            ["lang", "gram", "n"],
        )

    rows = docs.select(text, lang).where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = arrow_map(rows, count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # a limit right on the row number lets Spark keep the first ones of each partition before the shuffle by language
    best = counts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= top)
    table: dict[str, list[tuple[int, int]]] = {}
    for r in best.collect():
        table.setdefault(r["lang"], []).append((r["gram"], r["rank"] - 1))
    langs = tuple(sorted(table))
    pairs = [np.array(sorted(table[k]), np.int64) for k in langs]
    return Profiles(top, langs, tuple(p[:, 0].astype(np.uint32) for p in pairs), tuple(p[:, 1] for p in pairs))


def predicted_language(profiles: Profiles, text: str = "text") -> Column:
    """struct(lang_pred, score): the nearest profile and its lead over the next one, 0 to 1.

    A null text or one without a letter is ``und`` with score 0, as is every text if nothing was learned.
    A tie of distances goes to the first language in alphabetical order.
    """

    @F.arrow_udf("lang_pred string, score double")
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            found = [profiles.predict(x) for x in column.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang_pred", "score"]
            )

    return each(F.col(text))
