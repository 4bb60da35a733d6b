"""SimHash near-duplicates: fingerprints embedded as per-segment bit counts and joined in a grid.

A fingerprint is cut into 32 segments of two bits; its embedding is the 32 bit counts, each 0 to 2, packed
into one long. The Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints. The grid has the 32 coordinates in ``radius + 2`` blocks: embeddings within ``radius`` of each
other differ in at most ``radius`` blocks, so they agree in two at least and share the unit cell of some
pair of blocks. Candidates of a cell are kept by Manhattan distance, then by exact Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clear_of, slices, stage
from .components import components

SEED, SHINGLE, SEGMENTS = 42, 3, 32
LOW_BITS = 0x5555555555555555
#: Members of a cell that one task compares with each other; larger cells are dealt out in pairs of chunks.
CHUNK = 1024


def shingle_hashes(text: bytes | None) -> list[int]:
    """XXH64 of each three-word shingle, repeats included; of all words if there are fewer; of none, none."""
    words = (text or b"").lower().split()
    if not words:
        return []
    if len(words) < SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return [digest(join(t), SEED) for t in zip(words, words[1:], words[2:])]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of ``sizes`` hashes; a run of none has fingerprint zero.

    Bits are added up in byte lanes, at most 255 rows at a time.
    """
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    starts = np.cumsum(n) - n
    blocks = (n + 254) // 255
    first = np.cumsum(blocks) - blocks
    at = np.repeat(starts, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    lane = np.uint64(0x0101010101010101)
    value = np.zeros(len(full), np.uint64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & lane, at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = 2 * counts > n[:, None]
        for byte in range(8):
            value |= over[:, byte].astype(np.uint64) << np.uint64(8 * byte + bit)
    out[full] = value
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 512):
        lists = [shingle_hashes(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        sizes = np.array([len(x) for x in lists], np.int64)
        flat = np.fromiter((h for x in lists for h in x), np.uint64, int(sizes.sum()))
        prints = majority(flat, sizes).view(np.int64)
        carried = zip(batch.schema.names[2:], batch.columns[2:])
        names, columns = zip(("id", batch.column(0)), ("fp", pa.array(prints)), *carried)
        yield pa.RecordBatch.from_arrays(list(columns), names=list(names))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[Column, ...] = ()) -> DataFrame:
    """(id, fp) per document, then longs ``carry``; fp is the fingerprint as a signed long. Null text counts as empty."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), *carry)
    shape = ", ".join([f"id {docs.schema[doc_id].dataType.simpleString()}", "fp long", *[f"{c} long" for c in rows.columns[2:]]])
    return rows.mapInArrow(_fingerprint, shape)


def embedding(fp: Column) -> Column:
    """The 32 bit counts, each in two bits of a long; added bit by bit, as the sum may pass the sign bit."""
    x, y = fp.bitwiseAND(F.lit(LOW_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS))
    return x.bitwiseXOR(y).bitwiseOR(F.shiftleft(x.bitwiseAND(y), 1))


def block_masks(radius: int) -> list[int]:
    """A mask over the packed coordinates for each pair of the ``radius + 2`` blocks, as signed longs."""
    edges = np.linspace(0, SEGMENTS, radius + 3).round().astype(int)
    blocks = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in (x | y for x, y in combinations(blocks, 2))]


def grid(prints: DataFrame, radius: int) -> DataFrame:
    """Rows (axis, cell, part_a, part_b, fp) of all cells with two members or more.

    A cell of more than ``CHUNK`` members is dealt out: each chunk meets each other chunk in a group of
    its own, so groups are bounded and none of their pairs is lost.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("axis"), F.col("e").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(block_masks(radius))])
    rows = prints.select("fp", embedding(F.col("fp")).alias("e")).select("fp", F.explode(cells).alias("c")).select("fp", "c.*")
    sizes = rows.groupBy("axis", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    groups = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda d: F.struct(F.least(d, F.col("own")).alias("part_a"), F.greatest(d, F.col("own")).alias("part_b")),
    )
    return (
        rows.join(sizes, ["axis", "cell"])
        .withColumn("chunks", chunks)
        .withColumn("own", own)
        .select("axis", "cell", F.explode(groups).alias("g"), "fp")
        .select("axis", "cell", "g.part_a", "g.part_b", "fp")
    )


def near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """True where fingerprints are within ``radius``: Manhattan distance of embeddings first, then Hamming."""
    low, one = np.uint64(LOW_BITS), np.uint64(1)
    diff = ((x & low) + ((x >> one) & low)) ^ ((y & low) + ((y >> one) & low))
    odd, even = diff & low, (diff >> one) & low
    manhattan = np.bitwise_count(odd) + 2 * np.bitwise_count(even & ~odd)
    out = np.zeros(np.broadcast(x, y).shape, bool)
    at = np.nonzero(manhattan <= radius)
    x, y = np.broadcast_arrays(x, y)
    out[at] = np.bitwise_count(x[at] ^ y[at]) <= radius
    return out


def linked(fp: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal ``run`` as a star per component: positions and their smallest position."""
    lefts, rights = [], []
    edges = np.flatnonzero(np.r_[True, run[1:] != run[:-1], True])
    short = min(32, int(np.diff(edges).max(initial=0)) - 1)
    for lag in range(1, short + 1):
        i = np.flatnonzero(run[lag:] == run[:-lag])
        i = i[near(fp[i], fp[i + lag], radius)]
        lefts.append(i)
        rights.append(i + lag)
    for k in np.flatnonzero(np.diff(edges) > short + 1):
        a, b = edges[k], edges[k + 1]
        for at in range(a, b, 256):
            i, j = np.nonzero(near(fp[at : min(at + 256, b), None], fp[None, at:b], radius))
            later = j > i
            lefts.append(i[later] + at)
            rights.append(j[later] + at)
    i, j = np.concatenate(lefts or [np.empty(0, int)]), np.concatenate(rights or [np.empty(0, int)])
    label = np.arange(len(fp))
    while True:
        least = np.minimum(label[i], label[j])
        old = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == old).all():
            break
    at = np.flatnonzero(label != np.arange(len(fp)))
    return at, label[at]


class _Verify:
    """Links of whole groups from partitions that are sorted by group."""

    def __init__(self, radius: int):
        self.radius = radius

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in slices(batches, 16384):
            rows = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)])
            held = [np.concatenate([*held, rows], axis=1)]
            # the last group may go on in the next batch
            same = (held[0][:4] == held[0][:4, -1:]).all(axis=0)
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield self.links(held[0][:, :cut])
                held = [held[0][:, cut:]]
        if held and held[0].shape[1]:
            yield self.links(held[0])

    def links(self, rows: np.ndarray) -> pa.RecordBatch:
        run = np.r_[0, np.cumsum((rows[:4, 1:] != rows[:4, :-1]).any(axis=0))]
        at, root = linked(rows[4].view(np.uint64), run, self.radius)
        return pa.RecordBatch.from_arrays([pa.array(rows[4][at]), pa.array(rows[4][root])], names=["a", "b"])


def near_links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all pairs within ``radius`` bits."""
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["axis", "cell", "part_a", "part_b"]
    groups = grid(prints, radius).repartition(tasks, *keys).sortWithinPartitions(*keys, "fp")
    return groups.mapInArrow(_Verify(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``; fingerprints within ``radius`` bits are linked.

    Equal fingerprints are brought together before anything is compared, so a group of copies costs one
    row however large it is. ``component_id`` is the smallest id reachable, itself included.

    Null and blank texts have fingerprint zero and are linked like any other. A null id takes part and
    gets its component's smallest id, null if there is none. Repeated rows come back repeatedly. No
    rows: no rows.
    """
    marked = stage(fingerprints(docs, doc_id, text), "prints")
    return marked.join(classes(marked, radius), "fp").select(
        F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def classes(marked: DataFrame, radius: int) -> DataFrame:
    """(fp, root, component_id) of all fingerprints of ``marked`` (id, fp): the smallest fingerprint and id of their group."""
    prints = stage(marked.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = components(near_links(prints, radius)).select(F.col("node").alias("fp"), "root")
    prints = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    prints = stage(prints, "rooted")
    least = prints.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(least, "root").select("fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3, unique_ids: bool = True) -> DataFrame:
    """The document with the smallest id of each group, with all columns; repeated rows of it stay once.

    Rows with a null id stay only where their whole group has none, one of each such group. Of several rows
    with the smallest id of a group the one whose hash is least stays. With ``unique_ids`` an id stays once
    in all, even if its rows are in different groups; without, each group keeps its row. Rows are told
    apart by two 64-bit hashes of all their columns and of which of them are null.
    """
    names = docs.columns
    keys = [clear_of("row_a_", names), clear_of("row_b_", names)]
    marks = [F.xxhash64(F.lit(i), *[F.col(c).isNull() for c in names], *names) for i in range(2)]
    marked = stage(fingerprints(docs, doc_id, text, (marks[0].alias("a"), marks[1].alias("b"))), "prints")
    grouped = marked.join(classes(marked, radius), "fp")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "a", "b")).alias("row")
    kept = grouped.groupBy("root").agg(first).select("row.*")
    if unique_ids:
        own = [F.when(F.col("none"), F.col(c)) for c in ("a", "b")]
        kept = kept.groupBy("id", *own).agg(F.min(F.struct("a", "b")).alias("row")).select("row.*")
    kept = kept.select(F.col("a").alias(keys[0]), F.col("b").alias(keys[1]))
    return docs.withColumns(dict(zip(keys, marks))).join(kept, keys, "left_semi").dropDuplicates(keys).select(*names)
