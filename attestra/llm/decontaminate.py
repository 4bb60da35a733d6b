"""Benchmark decontamination by spaced seeds: token windows are hashed under masks that ignore some positions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_of, slices

#: ASCII to lower case, and to a blank where it is neither letter nor digit; bytes of other characters stay.
_FOLDED = bytes(ord(chr(b).lower()) if b >= 128 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


@dataclass(frozen=True)
class Seeds:
    """``masks``: 1 compares a token, 0 ignores it. Each compares six or seven tokens; together they meet any run of 13
    tokens with one substitution, and most with two or three.

    An overlap is a stretch on one diagonal of a document and an item, of ``min_overlap`` tokens or more (the
    whole item if it is shorter), with ``min_match`` of its tokens equal. ``block_tokens``: benchmark tokens
    that are broadcast at a time; a larger benchmark is searched in several blocks.
    """

    masks: tuple[str, ...] = ("111111", "1110111", "1101100011", "1011000100101")
    min_overlap: int = 13
    min_match: float = 0.8
    block_tokens: int = 1_000_000


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLDED).split()


def offsets(mask: str) -> list[int]:
    return [i for i, x in enumerate(mask) if x == "1"]


def window_hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """A 64-bit hash of the compared tokens at each start; zero where one of them is unknown (id 0)."""
    span, at = len(mask), offsets(mask)
    n = len(ids) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, known = np.full(n, len(at), np.uint64), np.ones(n, bool)
    with np.errstate(over="ignore"):
        for i in at:
            part = ids[i : i + n]
            known &= part > 0
            h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    h[~known] = 0
    return h


class Index:
    """Seeds of one block of the benchmark: vocabulary, item tokens, and sorted hashes with their places."""

    def __init__(self, items: list[tuple[int, bytes | None]], seeds: Seeds):
        self.seeds, self.vocabulary = seeds, {}
        number = self.vocabulary
        self.ids = [k for k, _ in items]
        self.texts = [
            np.array([number.setdefault(w, len(number) + 1) for w in tokens(t)], np.uint64) for _, t in items
        ]
        self.tables = []
        for mask in self.masks():
            hashes = [window_hashes(t, mask) for t in self.texts]
            where = [(np.full(len(h), k), np.arange(len(h))) for k, h in enumerate(hashes)]
            flat = np.concatenate([*hashes, np.empty(0, np.uint64)])
            order = np.argsort(flat, kind="stable")
            item = np.concatenate([*(a for a, _ in where), np.empty(0, int)])[order]
            place = np.concatenate([*(b for _, b in where), np.empty(0, int)])[order]
            quick = np.zeros(1 << 20, bool)
            quick[flat & np.uint64((1 << 20) - 1)] = True
            self.tables.append((mask, flat[order], item, place, quick))

    def masks(self) -> list[str]:
        """The seeds, and full windows as long as items that are too short for some seed."""
        short = {len(t) for t in self.texts if 0 < len(t) < max(map(len, self.seeds.masks))}
        return [*self.seeds.masks, *("1" * n for n in sorted(short) if "1" * n not in self.seeds.masks)]

    def diagonals(self, ids: np.ndarray) -> set[tuple[int, int]]:
        """(item, document position minus item position) of all seed hits."""
        found = set()
        for mask, hashes, item, place, quick in self.tables:
            h = window_hashes(ids, mask)
            at = np.flatnonzero((h != 0) & quick[h & np.uint64((1 << 20) - 1)])
            first, last = np.searchsorted(hashes, h[at]), np.searchsorted(hashes, h[at], side="right")
            for p, a, b in zip(at.tolist(), first.tolist(), last.tolist()):
                found.update((i, p - q) for i, q in zip(item[a:b].tolist(), place[a:b].tolist()))
        return found

    def overlaps(self, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, start in the document, length, equal tokens): the best overlap with each item, in item order."""
        best: dict[int, tuple[int, int, int, int]] = {}
        for k, diagonal in self.diagonals(ids):
            text = self.texts[k]
            a, b = max(0, diagonal), min(len(ids), diagonal + len(text))
            equal = ids[a:b] == text[a - diagonal : b - diagonal]
            i, j = longest_stretch(equal, self.seeds.min_match)
            if j - i >= min(self.seeds.min_overlap, len(text)):
                own = (int(equal[i:j].sum()), -(a + i), k, j - i)
                best[k] = max(best.get(k, own), own)
        return [(k, -s, n, m) for m, s, k, n in sorted(best.values(), key=lambda x: x[2])]


def longest_stretch(equal: np.ndarray, part: float) -> tuple[int, int]:
    """The longest [i, j) with at least ``part`` of its flags set, the first of equally long ones; trimmed to set ends.

    With a gain of 1 - part for a set flag and a loss of part for another, these are stretches between
    places of a running sum that does not fall. The earliest start for each end is found in the running
    minimum, which never rises.
    """
    total = np.round(np.r_[0.0, np.cumsum(equal - part)], 9)
    least = np.minimum.accumulate(total)
    start = np.searchsorted(-least, -total, side="left")
    length = np.arange(len(total)) - start
    j = int(np.argmax(length))
    i = int(start[j])
    hits = np.flatnonzero(equal[i:j])
    return (i + int(hits[0]), i + int(hits[-1]) + 1) if len(hits) else (0, 0)


class _Search:
    """Rows (carried columns, item_id, overlap_start, overlap_tokens, equal_tokens), one per overlap of a document and an item."""

    def __init__(self, index):
        self.index = index

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = self.index.value
        get = index.vocabulary.get
        for batch in slices(batches, 512):
            rows, found = [], []
            for row, text in enumerate(batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()):
                ids = np.array([get(w, 0) for w in tokens(text)], np.uint64)
                hits = index.overlaps(ids)
                rows += [row] * len(hits)
                found += [(index.ids[k], *rest) for k, *rest in hits]
            if rows:
                kept = [c.take(pa.array(rows)) for c in batch.columns[:-1]]
                new = [pa.array(c, pa.int64()) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays([*kept, *new], names=[*batch.schema.names[:-1], *_FOUND])


_FOUND = ("item_id", "overlap_start", "overlap_tokens", "equal_tokens")


def _blocks(items: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple[int, bytes | None]]]:
    """Benchmark items in blocks of about ``most`` tokens; an item is never cut."""
    block, size = [], 0
    rows = items.select(F.col(item_id).cast("long"), F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
    for key, body in rows.orderBy(F.col(item_id).asc_nulls_first()).toLocalIterator():
        block.append((key, bytes(body)))
        size += len(tokens(block[-1][1]))
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_overlaps(
    docs: DataFrame, items: DataFrame, carry: tuple[str, ...] = ("doc_id",), seeds: Seeds = Seeds(),
    text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """A row per document and benchmark item that overlap, from whole texts: ``carry`` and the place of the best overlap.

    The benchmark is the small side: blocks of bounded size are broadcast and all documents pass by them
    without a shuffle; only tokens the block knows can start a hit.

    Null and blank texts and items overlap with nothing. Repeated rows are reported each; of items with
    one text each is reported. An empty table on either side gives no rows.
    """
    context = docs.sparkSession.sparkContext
    body = clear_of("body_", list(carry))
    rows = docs.select(*[F.col(c) for c in carry], F.col(text).alias(body))
    shape = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]], *[f"{c} long" for c in _FOUND]])
    parts = [rows.mapInArrow(_Search(context.broadcast(Index(b, seeds))), shape) for b in _blocks(items, item_id, item_text, seeds.block_tokens)]
    if not parts:
        return rows.where("false").select(*carry, *[F.lit(None).cast("long").alias(c) for c in _FOUND])
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


class _Clean:
    """The rows whose text, the last column, overlaps no item; without that column."""

    def __init__(self, index):
        self.index = index

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = self.index.value
        get = index.vocabulary.get
        for batch in slices(batches, 512):
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            clean = [not index.overlaps(np.array([get(w, 0) for w in tokens(t)], np.uint64)) for t in texts]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(clean))


def drop_contaminated(docs: DataFrame, items: DataFrame, seeds: Seeds = Seeds(), text: str = "text") -> DataFrame:
    """The documents that overlap with no benchmark item, with all columns; cases as for ``find_overlaps``."""
    context, names = docs.sparkSession.sparkContext, docs.columns
    body = clear_of("body_", names)
    for block in _blocks(items, "item_id", "text", seeds.block_tokens):
        rows = docs.withColumn(body, F.col(text))
        docs = rows.mapInArrow(_Clean(context.broadcast(Index(block, seeds))), docs.schema).select(*names)
    return docs
