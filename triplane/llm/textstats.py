"""Whole-text statistics of documents, computed a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard

from .common import MULTIPLIERS, Words, chunks, mix

SYMBOLS = b"#*$%&|<>"


def _marks(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


IS_SYMBOL = _marks(SYMBOLS)
IS_UPPER = _marks(bytes(range(65, 91)))
IS_LETTER = _marks(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
IS_DIGIT = _marks(b"0123456789")
IS_STOP = _marks(b".,;:?")
IS_SHOUT = _marks(b"!")
IS_CODE = _marks(b"{}[]()=_/\\@~^+`\"")
IS_LINE = _marks(b"\n")
IS_POINT = np.array([(b & 0xC0) != 0x80 for b in range(256)])


def per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags in each document."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(h: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more, the first one included."""
    if len(h) < 4:
        return 0
    window = mix(h[:-2] * MULTIPLIERS[0] + h[1:-1] * MULTIPLIERS[1] + h[2:] * MULTIPLIERS[2])
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(h), bool)
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit[:-2] |= twice
    hit[1:-1] |= twice
    hit[2:] |= twice
    return int(hit.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else []
    return len(lines) - len(set(lines))


class Statistics:
    """Of the documents i to j of a batch; every array has a value for each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.offsets = offsets
        self.n_bytes = np.diff(offsets)
        words = Words(data, offsets, lower=False)
        self.words = words
        self.n_words = np.diff(words.at)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[words.start] += 1
        np.subtract.at(inside, words.end, 1)
        within = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        self.word_chars = per_document(IS_POINT[data] & within, offsets)
        count = lambda table: per_document(table[data], offsets)
        self.n_symbols = count(IS_SYMBOL)
        self.count = count
        self.texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        self.n_dup_lines = np.array([repeated_lines(x) for x in self.texts], np.int64)
        spans = list(zip(words.at[:-1].tolist(), words.at[1:].tolist(), strict=True))
        self.n_repeat_words = np.array([repeated_words(words.hash[a:b]) for a, b in spans], np.int64)
        self.spans = spans


def statistics(data: np.ndarray, offsets: np.ndarray) -> Iterator[Statistics]:
    for i, j in chunks(offsets):
        yield Statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


_compressor: zstandard.ZstdCompressor | None = None


def squeezed(text: bytes) -> int:
    """Bytes of the text as one zstandard frame at level 3."""
    global _compressor
    _compressor = _compressor or zstandard.ZstdCompressor(level=3, write_content_size=False)
    return len(_compressor.compress(text))
