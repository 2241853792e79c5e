"""Quality rules by compression bands: zstandard ratios of whole texts and of fixed chunks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, utf8
from .textstats import Statistics, squeezed, statistics


@dataclass(frozen=True)
class Bands:
    """Limits of bytes / compressed bytes: (texts below so many bytes, least ratio, greatest ratio).

    A short text hardly compresses and a long one compresses more, so the limits rise with length.
    ``chunk_bytes``: the fixed chunks; a text fails if more than ``bad_chunks`` of its bytes lie in
    chunks outside the limits for the chunk's own length.
    """

    limits: tuple[tuple[float, float, float], ...] = (
        (200, 0.5, 2.5), (800, 1.1, 3.0), (3200, 1.3, 3.5), (12800, 1.4, 4.0), (float("inf"), 1.5, 4.5),
    )
    chunk_bytes: int = 4096
    bad_chunks: float = 0.25
    min_words: int = 50
    repeat_percent: int = 50

    def outside(self, n_bytes: int, ratio: float) -> bool:
        low, high = next((a, b) for top, a, b in self.limits if n_bytes < top)
        return not low <= ratio <= high


COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, bad_bytes long"
)


def judged(s: Statistics, bands: Bands) -> dict[str, np.ndarray]:
    ratios, bad, kept = [], [], []
    failed = (s.n_words < bands.min_words) | (100 * s.n_repeat_words > bands.repeat_percent * s.n_words)
    for text, fails in zip(s.texts, failed.tolist(), strict=True):
        n = len(text)
        ratio = n / squeezed(text) if n else 0.0
        parts = [text[k : k + bands.chunk_bytes] for k in range(0, n, bands.chunk_bytes)] if n > bands.chunk_bytes else []
        wrong = sum(len(x) for x in parts if bands.outside(len(x), len(x) / squeezed(x)))
        ratios.append(ratio)
        bad.append(wrong)
        kept.append(not fails and not bands.outside(n, ratio) and wrong <= bands.bad_chunks * n)
    return {
        "n_words": s.n_words, "word_chars": s.word_chars, "n_symbols": s.n_symbols, "n_dup_lines": s.n_dup_lines,
        "n_repeat_words": s.n_repeat_words, "base_failed": failed, "kept": np.array(kept, bool),
        "ratio": np.array(ratios, float), "bad_bytes": np.array(bad, np.int64),
    }


def quality_rules(docs: DataFrame, bands: Bands = Bands(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its counts, ``base_failed``, the whole-text ratio, the bytes in chunks
    outside the band, and ``kept``. One pass over the texts, no shuffle.

    A null or empty text has no words and ratio 0: it fails. Repeated rows are judged each; other
    columns are not read, so their names can't clash.
    """
    kind = docs.schema[key].dataType.simpleString()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [judged(s, bands) for s in statistics(*utf8(batch.column(1)))]
        columns = {k: pa.array(np.concatenate([r[k] for r in rows])) for k in rows[0]}
        return pa.RecordBatch.from_arrays([batch.column(0), *columns.values()], [key, *columns])

    return arrow_map(docs.select(key, text), each, f"{key} {kind}, {COLUMNS}")
