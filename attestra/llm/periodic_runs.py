"""Periodic runs of words, found by online dyadic square catching.

A catcher stands on every completed block of L = 1, 2, 4, ... words. Appending a word completes, per level, one
suffix of L words; it is compared with the two catchers whose blocks start 2L to 4L words before it. Equality at
distance q says that the block repeats q words later, and as long as neighbouring blocks do so at the same
distance, their squares belong to one stretch. A stretch that ends is extended word by word (by fewer than L
words on either side) and becomes a run. Every period q >= 2 has the level with 2L <= q < 4L, and each run of
exponent 3 holds three whole blocks of that level; period 1 is compared with the word before.

Each word takes part in two comparisons a level, so a text of n words costs n log n steps and O(n) memory. The
words of many texts are appended in one go, each text closed by a word that occurs nowhere else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clear_of, slices

_OPEN = np.uint64(0x5851F42D4C957F2D)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


@dataclass(frozen=True)
class RunRules:
    """What counts as a run: at least ``min_words`` long and at least ``min_power`` (2 or more) periods."""

    min_words: int = 24
    min_power: int = 3

    def __post_init__(self) -> None:
        if self.min_power < 2:
            raise ValueError("a run has two periods at least")


def _suffix_hashes(short: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all stretches of ``2 * length`` words from those of ``length`` words."""
    if len(short) <= length:
        return short[:0]
    left, right = short[:-length], short[length:]
    mixed = left * np.uint64(0x9E3779B97F4A7C15) + right * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ (mixed >> np.uint64(29))


def _streaks(hits: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column, first row, rows) of the vertical stretches of at least ``least`` hits."""
    empty = np.zeros(0, np.int64)
    if len(hits) < least:
        return empty, empty, empty
    dense = hits
    for step in range(1, least):  # a cheap look first: nearly always there are none
        dense = dense[:-1] & hits[step:]
    if not dense.any():
        return empty, empty, empty
    columns = np.flatnonzero(dense.any(axis=0))
    part = np.zeros((len(columns), len(hits) + 2), np.int8)
    part[:, 1:-1] = hits[:, columns].T
    change = np.diff(part, axis=1)
    col, first = np.nonzero(change == 1)
    last = np.nonzero(change == -1)[1]
    long = last - first >= least
    return columns[col[long]], first[long], (last - first)[long]


def _inside(runs: list[tuple[int, int, int]], first: np.ndarray, last: np.ndarray, period: np.ndarray) -> np.ndarray:
    """True for stretches inside a known run whose period divides theirs: the same run again.

    Looks at a few runs before each stretch only. What it misses is found equal to a known run later.
    """
    if not runs or not len(first):
        return np.zeros(len(first), bool)
    known = np.array(sorted(runs), np.int64)
    at = np.searchsorted(known[:, 0], first, side="right") - 1
    covered = np.zeros(len(first), bool)
    for back in range(6):
        i = np.maximum(at - back, 0)
        covered |= (at >= back) & (known[i, 0] <= first) & (known[i, 1] >= last) & (period % known[i, 2] == 0)
    return covered


def _equal_before(codes: np.ndarray, i: int, q: int, most: int) -> int:
    """How many words before ``i``, up to ``most``, equal the words ``q`` later."""
    most = min(most, i)
    differ = np.flatnonzero(codes[i - most : i] != codes[i - most + q : i + q])
    return most if not len(differ) else most - 1 - int(differ[-1])


def _equal_after(codes: np.ndarray, i: int, q: int, most: int) -> int:
    """How many words from ``i`` on, up to ``most``, equal the words ``q`` later."""
    most = min(most, len(codes) - q - i)
    differ = np.flatnonzero(codes[i : i + most] != codes[i + q : i + q + most])
    return most if not len(differ) else int(differ[0])


def find_runs(codes: np.ndarray, rules: RunRules = RunRules()) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of the maximal runs in a sequence of word numbers, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    x = codes.astype(np.uint64)
    hashes = (x + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(32)
    length, n, power = 1, len(codes), rules.min_power

    def close(first: int, last: int, q: int, around: int) -> None:
        """A finished stretch of equal words ``[first, last)`` at distance ``q``: extend, check, keep."""
        start = first - _equal_before(codes, first, q, around)
        end = last + _equal_after(codes, last, q, around) + q
        if end - start < max(rules.min_words, power * q) or found.get((start, end), q + 1) <= q:
            return
        if np.array_equal(codes[start : end - q], codes[start + q : end]):
            found[start, end] = q

    if n:
        twins = (x[1:] == x[:-1]).reshape(-1, 1)
        for _, first, rows in zip(*_streaks(twins, power - 1), strict=True):
            close(int(first), int(first + rows), 1, 1)
    while power * 2 * length <= n:
        blocks = -(-len(hashes) // length)
        table = np.full(blocks * length, _OPEN)  # suffixes that no word has completed yet equal none
        table[: len(hashes)] = hashes
        table = table.reshape(blocks, length)
        # a stretch of (power - 1) * q >= (power - 1) * 2L equal words holds so many whole blocks
        least = 2 * (power - 1) - 1
        for behind in (2, 3):
            if blocks <= behind:
                continue
            column, row, rows = _streaks(table[behind:] == table[:-behind, :1], least)
            first = row * length
            last = first + rows * length
            period = behind * length + column
            # the whole stretch has to be long enough even where it grows at both ends
            enough = last - first + 2 * (length - 1) >= np.maximum((power - 1) * period, rules.min_words - period)
            known = [(a, b, q) for (a, b), q in found.items()]
            new = enough & ~_inside(known, first, last + period, period)
            order = np.lexsort((first[new], period[new]))
            for i in np.flatnonzero(new)[order]:
                close(int(first[i]), int(last[i]), int(period[i]), length)
        hashes = _suffix_hashes(hashes, length)
        length *= 2
    return sorted((a, b, q) for (a, b), q in found.items())


def _batch_runs(texts: list[str | None], rules: RunRules) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs (start, length, period) of each text."""
    words = [(t or "").encode().split() for t in texts]  # bytes are split at exactly the blanks meant here
    numbers = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
    sizes = np.array([len(ws) for ws in words], np.int64)
    ends = np.cumsum(sizes + 1) - 1  # place of the closing word
    codes = np.empty(int(sizes.sum()) + len(words), np.int64)
    inner = np.ones(len(codes), bool)
    inner[ends] = False
    codes[inner] = np.fromiter((numbers[w] for ws in words for w in ws), np.int64, int(sizes.sum()))
    codes[ends] = len(numbers) + np.arange(len(words))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
    starts = ends - sizes
    for a, b, q in find_runs(codes, rules):
        i = int(np.searchsorted(ends, a))
        runs[i].append((a - int(starts[i]), b - a, q))
    yield from zip(words, runs, strict=True)


def _collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by spaces, of each run only its first period."""
    if not runs:
        return b" ".join(words).decode()
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([w for w, k in zip(words, kept, strict=True) if k]).decode()


class _Detect:
    """Adds runs and collapsed text to batches whose last column is the text."""

    def __init__(self, rules: RunRules, schema: pa.Schema, chunk: int) -> None:
        self.rules, self.schema, self.chunk = rules, schema, chunk

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            at = 0
            while at < batch.num_rows:
                size, end = 0, at
                while end < batch.num_rows and (end == at or size < self.chunk):
                    size += len(batch.columns[-1][end].as_buffer() or b"") if batch.columns[-1][end].is_valid else 0
                    end += 1
                yield self._one(batch.slice(at, end - at))
                at = end

    def _one(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, runs, collapsed = [], [], []
        for words, found in _batch_runs(batch.columns[-1].to_pylist(), self.rules):
            n_words.append(len(words))
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
            collapsed.append(_collapse(words, found))
        added = [n_words, runs, collapsed]
        types = [f.type for f in self.schema][-3:]
        arrays = [pa.array(v, t) for v, t in zip(added, types, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], schema=self.schema)


def detect_runs(docs: DataFrame, text: str = "text", rules: RunRules = RunRules(), chunk: int = 4_000_000) -> DataFrame:
    """All rows and columns of ``docs`` with ``n_words``, ``runs`` and ``collapsed``.

    ``runs``: start, length and period (in words, from 0) of every maximal run, by start, then period.
    ``collapsed``: the words joined by one space, without those that a run holds after its first period.
    Texts are handled whole, as many at a time as have ``chunk`` bytes, so a task holds a few of them and
    the longest one. No shuffle.

    Null, empty and blank texts: no words, no runs, empty ``collapsed``. Rows do not depend on each other, so
    repeated rows and ids, and nulls elsewhere, change nothing. No rows: no rows. Columns of the names of the
    added ones are replaced.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_words", "runs", "collapsed")]
    body = clear_of("text_", docs.columns)
    fields = [docs.schema[c] for c in names]
    schema = T.StructType(
        [
            *fields,
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T._parse_datatype_string(RUNS)),
            T.StructField("collapsed", T.StringType()),
        ]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    source = docs.select(*[F.col(c) for c in names], F.col(text).alias(body))
    return source.mapInArrow(_Detect(rules, to_arrow_schema(schema), chunk), schema)
