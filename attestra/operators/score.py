"""BM25 scores of a bounded set of questions: a block of questions by a block of passages at a time.

A question shares some gram with nearly every passage, so a row per (question, passage, term) is far more than the
input. Here tasks pack their passages into blocks of term counts, once and without knowing the questions: a block numbers
its own terms and lists them. A round of questions looks these lists up in its vocabulary, multiplies a matrix of question
weights by a matrix of term values, and only the best passages of a task's questions leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast

#: rows ``pack`` makes, one per block: its terms and how many passages have them, and the passages themselves (see ``_frozen``)
PACKED = "terms binary, passages binary"
#: passages of a block and questions of one product of matrices
PASSAGES, QUESTIONS = 2048, 1024
#: a term that this share of (question, passage) pairs has in common goes through the matrix product
DENSE = 0.001
#: groups of passages whose best scores bound the ``k``-th best from below
_HEADS = 64
#: pairs scored exactly at a time
_PAIRS = 256
_WORDS_KEPT = 200_000
_NO_POS = np.iinfo(np.int64).min


def _spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(list, place in it) of all items of lists of these lengths."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(values[order], first)


def _frozen(**columns: pa.Array) -> bytes:
    """Arrays of any lengths as one value."""
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns.values()]
    batch = pa.RecordBatch.from_arrays(lists, names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _thawed(value: pa.Scalar) -> dict[str, pa.Array]:
    batch = pa.ipc.open_stream(value.as_buffer()).read_next_batch()
    return {name: batch.column(name).flatten() for name in batch.schema.names}


def _by_group(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Blocks of passages, in the order of language groups, so that few blocks have several."""
    first = pc.struct_field(pc.list_element(batch.column("parts"), 0), "lang_group")
    rows = batch.take(pc.sort_indices(first))
    for start in range(0, rows.num_rows, PASSAGES):
        yield rows.slice(start, PASSAGES)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``PACKED`` from (pos, parts of lang_group, doc_len, words).

    Rows of one position, group and length are one passage, as they are to the postings.
    """
    number: dict[str, int] = {}
    names: list[str] = []
    seen: dict[str, list[int]] = {}

    def terms_of(word: str) -> list[int]:
        """Numbers of the word and of its 3-grams, as ``explode_features`` makes them."""
        if not word:
            return []
        found = []
        for feature in [word] + [word[i : i + 3] for i in range(max(1, len(word) - 2))]:
            at = number.get(feature)
            if at is None:
                at = number[feature] = len(names)
                names.append(feature)
            found.append(at)
        return found

    for batch in (block for rows in batches if rows.num_rows for block in _by_group(rows)):
        parts = batch.column("parts")
        rows = pc.list_parent_indices(parts).to_numpy()
        flat = parts.flatten()
        length = flat.field("doc_len").to_numpy(zero_copy_only=False)
        coded = flat.field("lang_group").dictionary_encode()
        groups, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # rows of one position, group and length become one part
        key = np.stack([rows.astype(np.int64), codes, length.astype(np.int64)], axis=1)
        unlike, part_of = np.unique(key, axis=0, return_inverse=True)
        part_of = part_of.reshape(-1)
        copies = np.bincount(part_of, minlength=len(unlike))

        lists = pc.split_pattern(flat.field("words"), " ")
        owner = pc.list_parent_indices(lists).to_numpy()
        words = lists.flatten().dictionary_encode()
        for word in (distinct := words.dictionary.to_pylist()):
            if word not in seen:
                seen[word] = terms_of(word)
        found = [seen[w] for w in distinct]
        sizes = np.array([len(f) for f in found], np.int64)
        starts = np.cumsum(sizes) - sizes
        all_terms = np.array([t for f in found for t in f], np.int64)
        n_words, n_terms = max(1, len(distinct)), max(1, len(names))
        in_words, counts = _summed(part_of[owner] * n_words + words.indices.to_numpy(), np.ones(len(owner), np.int64))
        word = in_words % n_words
        item, place = _spread(sizes[word])
        entries, tfs = _summed((in_words // n_words)[item] * n_terms + all_terms[starts[word][item] + place], counts[item])
        part, term = entries // n_terms, entries % n_terms
        # the block numbers its own terms
        used = np.zeros(n_terms, bool)
        used[term] = True
        term = (np.cumsum(used) - 1)[term]
        own = [names[i] for i in np.flatnonzero(used)]
        group = unlike[:, 1]
        df = [np.bincount(term[group[part] == g], minlength=len(own)) for g in range(len(groups))]
        total = np.bincount(group, copies * unlike[:, 2], len(groups)).astype(np.int64)
        head = _frozen(
            term=pa.array(own, pa.string()),
            group=groups,
            df=pa.array(np.concatenate(df).astype(np.int32)),
            n=pa.array(np.bincount(group, copies, len(groups)).astype(np.int64)),
            total_len=pa.array(total),
        )
        body = _frozen(
            pos=pa.array(batch.column("pos").fill_null(int(_NO_POS)).to_numpy()),
            row=pa.array(unlike[:, 0].astype(np.int32)),
            group=pa.array(group.astype(np.int32)),
            length=pa.array(unlike[:, 2].astype(np.int32)),
            entries=pa.array(np.bincount(part, minlength=len(unlike)).astype(np.int32)),
            term=pa.array(term.astype(np.int32)),
            tf=pa.array(tfs.astype(np.int32)),
        )
        yield pa.RecordBatch.from_arrays([pa.array([head], pa.binary()), pa.array([body], pa.binary())], names=["terms", "passages"])
        if len(seen) > _WORDS_KEPT:
            number.clear(), names.clear(), seen.clear()


def _heads(column: pa.Array, vocabulary: pa.Array) -> Iterator[tuple[dict[str, pa.Array], np.ndarray]]:
    """The lists of terms of some blocks, with the number of each term in the vocabulary, -1 without one."""
    heads = [_thawed(value) for value in column]
    # looked up together, as the vocabulary is hashed each time
    at = pc.index_in(pa.concat_arrays([head["term"] for head in heads]), value_set=vocabulary).fill_null(-1)
    ends = np.cumsum([len(head["term"]) for head in heads])
    yield from zip(heads, np.split(at.to_numpy(zero_copy_only=False), ends[:-1]), strict=True)


#: terms of ``count_terms`` that stand for the passages of a group and for their total length
N, TOTAL_LEN = -1, -2


def counted(groups: list[str]) -> str:
    """Rows ``count_terms`` makes: passages of each language group with a term."""
    return ", ".join(["term int", *(f"{g} bigint" for g in groups)])


def count_terms(vocabulary: Broadcast, groups: list[str]) -> Callable:
    """Per task: passages with each term of the vocabulary, passages and their total length, by language group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = vocabulary.value
        totals = np.zeros((len(groups), len(asked)), np.int64)
        sizes = np.zeros((len(groups), 2), np.int64)
        for head, at in (x for batch in batches if batch.num_rows for x in _heads(batch.column("terms"), asked)):
            known = at >= 0
            df = head["df"].to_numpy().reshape(-1, len(at))
            for i, group in enumerate(head["group"].to_pylist()):
                totals[groups.index(group), at[known]] += df[i][known]
                sizes[groups.index(group)] += head["n"][i].as_py(), head["total_len"][i].as_py()
        terms = np.flatnonzero(totals.any(axis=0))
        columns = [np.r_[sizes[i], totals[i, terms]] for i in range(len(groups))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[N, TOTAL_LEN, terms].astype(np.int32)), *map(pa.array, columns)], names=["term", *groups]
        )

    return run


@dataclass
class _Passages:
    """Passages of a block: positions, and per part its row, group and length; entries have the numbers of a round's terms."""

    pos: np.ndarray
    row: np.ndarray
    group: np.ndarray
    length: np.ndarray
    part: np.ndarray
    term: np.ndarray
    tf: np.ndarray


def _unpacked(batch: pa.RecordBatch, vocabulary: pa.Array) -> Iterator[_Passages]:
    for (head, number), value in zip(_heads(batch.column("terms"), vocabulary), batch.column("passages"), strict=True):
        body = {k: v.to_numpy() for k, v in _thawed(value).items()}
        term = number[body["term"]]
        known = np.flatnonzero(term >= 0)
        part = np.repeat(np.arange(len(body["row"])), body["entries"])
        group = np.array(head["group"].to_pylist(), dtype=object)[body["group"]]
        yield _Passages(body["pos"], body["row"], group, body["length"], part[known], term[known], body["tf"][known].astype(np.float64))


@dataclass
class Block:
    """Up to ``QUESTIONS`` questions: their numbers and the weights ``w`` of (question ``q``, ``place`` of its term), by place."""

    numbers: np.ndarray
    q: np.ndarray
    place: np.ndarray
    w: np.ndarray


@dataclass
class Asked:
    """Questions that ask the same pools, mostly one. A place is a term of a pool.

    ``pools`` has the groups, mean length, terms and first place of each pool; ``dense`` marks the places that go through
    the matrix product.
    """

    pools: list[tuple[list[str], float, np.ndarray, int]]
    dense: np.ndarray
    blocks: list[Block]


def plan(question: np.ndarray, pool: np.ndarray, term: np.ndarray, weight: np.ndarray, density: np.ndarray, pools: list[tuple[list[str], float]]) -> list[Asked]:
    """Blocks of questions by the pools they ask; ``density`` is the share of its pool's passages that have an entry's term."""
    if not len(question):
        return []
    asks = np.zeros(question.max() + 1, np.int64)
    np.bitwise_or.at(asks, question, np.int64(1) << pool)
    made, n_terms = [], int(term.max()) + 1
    for kind in np.unique(asks[question]):
        mine = np.flatnonzero(asks[question] == kind)
        keys, first, place, asked = np.unique(pool[mine].astype(np.int64) * n_terms + term[mine], return_index=True, return_inverse=True, return_counts=True)
        numbers, q = np.unique(question[mine], return_inverse=True)
        dense = asked / len(numbers) * density[mine][first] > DENSE
        members = []
        for i in np.unique(keys // n_terms):
            start, end = np.searchsorted(keys, [i * n_terms, (i + 1) * n_terms])
            members.append((*pools[i], keys[start:end] % n_terms, int(start)))
        order = np.lexsort((place, q // QUESTIONS))
        q, place, w = q[order].astype(np.int32), place[order].astype(np.int32), weight[mine[order]]
        ends = np.searchsorted(q // QUESTIONS, np.arange(-(-len(numbers) // QUESTIONS) + 1))
        blocks = [
            Block(numbers[i * QUESTIONS : (i + 1) * QUESTIONS], q[a:b] - i * QUESTIONS, place[a:b], w[a:b])
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))
        ]
        made.append(Asked(members, dense, blocks))
    return made


@dataclass
class _Side:
    """What a block of passages has of the places of an ``Asked``: a matrix (passage, dense place) and the other entries."""

    pos: np.ndarray
    exact: np.ndarray
    rough: np.ndarray
    place: np.ndarray
    passage: np.ndarray
    value: np.ndarray


def _side(asked: Asked, places: list[np.ndarray], p: _Passages, k1: float, b: float) -> _Side | None:
    """``places`` has the place of each term of the vocabulary, or -1, for each pool; None without passages of these pools."""
    present = sorted(set(p.group))
    within = {g: p.group == g for g in present}
    inside = [np.logical_or.reduce([within[g] for g in pool[0] if g in within] or [np.zeros(len(p.group), bool)]) for pool in asked.pools]
    rows = np.unique(p.row[np.logical_or.reduce(inside)])
    if not len(rows):
        return None
    column = np.zeros(len(p.pos), np.int32)
    column[rows] = np.arange(len(rows))
    found = []
    for (_, avgdl, _, _), of_term, mine in zip(asked.pools, places, inside, strict=True):
        place = of_term[p.term]
        entry = np.flatnonzero(mine[p.part] & (place >= 0))
        part, tf = p.part[entry], p.tf[entry]
        norm = tf + (k1 * (1.0 - b + b * (p.length / avgdl)))[part]
        found.append((place[entry], column[p.row][part], tf * (k1 + 1.0) / norm))
    place, passage, value = (np.concatenate(x) for x in zip(*found, strict=True)) if len(found) > 1 else found[0]
    thick, compact, n_dense = asked.dense[place], np.cumsum(asked.dense) - 1, int(asked.dense.sum())
    cells = np.bincount(passage[thick].astype(np.int64) * n_dense + compact[place[thick]], value[thick], len(rows) * n_dense)
    cells = cells.astype(np.float64, copy=False).reshape(len(rows), n_dense)  # integers if there are none
    # rough scores may be off by a share of themselves, which holds for sums of positive values only
    rough = cells.astype(np.float32) if 0.0 <= b <= 1.0 and k1 >= 0.0 else cells
    thin = ~thick
    return _Side(p.pos[rows], cells, rough, place[thin], passage[thin], value[thin])


class _Questions:
    """A block of questions, laid out for products: dense entries by cell of the weight matrix, the others by place."""

    def __init__(self, block: Block, dense: np.ndarray):
        self.numbers, self.n_dense = block.numbers, int(dense.sum())
        thick = dense[block.place]
        self.cell = block.q[thick].astype(np.int64) * self.n_dense + (np.cumsum(dense) - 1)[block.place[thick]]
        self.weight = block.w[thick]
        self.q, self.w = block.q[~thick].astype(np.int32), block.w[~thick]
        self.asking = np.bincount(block.place[~thick], minlength=len(dense)).astype(np.int32)
        self.starts = np.cumsum(self.asking, dtype=np.int32) - self.asking
        self.most = int(np.bincount(block.q, minlength=1).max())


class _Scores:
    """Scores (question, passage): rough ones of all pairs, in single precision, and exact ones of some."""

    def __init__(self, questions: _Questions, side: _Side):
        self.side, n, kind = side, len(side.pos), side.rough.dtype
        self.weights = np.zeros((len(questions.numbers), questions.n_dense))
        self.weights.reshape(-1)[questions.cell] = questions.weight
        self.rough = self.weights.astype(kind) @ side.rough.T
        # places that few have: all questions of a passage's place
        asked = questions.asking[side.place]
        ends = np.cumsum(asked)
        self.entry = np.repeat((questions.starts[side.place] - ends + asked).astype(np.int32), asked)
        self.entry += np.arange(len(self.entry), dtype=np.int32)
        self.nth, self.w = np.repeat(np.arange(len(asked), dtype=np.int32), asked), questions.w
        self.cells = questions.q[self.entry] * np.int32(n)
        self.cells += side.passage[self.nth]
        np.add.at(self.rough.reshape(-1), self.cells, side.value.astype(kind)[self.nth] * questions.w.astype(kind)[self.entry])
        # a sum of n positive products in that precision is off by n + 2 roundings at most
        self.error = (questions.most + 8) * float(np.finfo(kind).eps)

    def exact(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact scores of pairs of a question and a passage."""
        pair_of = np.full(self.rough.size, -1, np.int32)
        pair_of[q * len(self.side.pos) + at] = np.arange(len(q))
        pair = pair_of[self.cells]
        hit = np.flatnonzero(pair >= 0)
        values = self.side.value[self.nth[hit]] * self.w[self.entry[hit]]
        scores = np.bincount(pair[hit], values, len(q)).astype(np.float64, copy=False)
        for i in range(0, len(q), _PAIRS):
            some = slice(i, i + _PAIRS)
            scores[some] += np.einsum("ij,ij->i", self.weights[q[some]], self.side.exact[at[some]])
        return scores


class _Best:
    """The best ``k`` passages of each question of a block so far; ties to nine decimals go by position."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.q, self.pos, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, scores: _Scores) -> None:
        rough, pos = scores.rough, scores.side.pos
        least, n = self.least * (1.0 - scores.error), rough.shape[1]
        if n > self.k:
            # k groups of passages have a score as high as the k-th highest of the groups' best
            wide = n >= 2 * _HEADS and self.k <= _HEADS
            heads = rough[:, : n // _HEADS * _HEADS].reshape(len(rough), -1, _HEADS).max(axis=1) if wide else rough
            heads = np.partition(heads, heads.shape[1] - self.k, axis=1)[:, heads.shape[1] - self.k]
            least = np.maximum(least, heads * (1.0 - 2.0 * scores.error))
        # lower by more than the rounding to nine decimals and that of this bound
        bound = np.maximum(least * (1.0 - 1e-6) - 2e-9, np.finfo(rough.dtype).tiny).astype(rough.dtype)
        q, at = np.divmod(np.flatnonzero(rough >= bound[:, None]), n)
        if not len(q):
            return
        score = scores.exact(q, at)
        q, pos, score = np.r_[self.q, q], np.r_[self.pos, pos[at]], np.r_[self.score, score]
        order = np.lexsort((pos, -np.round(score, 9), q))
        q, pos, score = q[order], pos[order], score[order]
        per_question = np.bincount(q, minlength=len(self.least))
        _, rank = _spread(per_question)
        kept = rank < self.k
        self.q, self.pos, self.score = q[kept], pos[kept], score[kept]
        last = rank == self.k - 1
        self.least[q[last]] = np.round(score[last], 9)


#: rows ``score`` makes
SCORED = "question int, pos bigint, score double"


def score(vocabulary: Broadcast, todo: Broadcast, k: int, k1: float, b: float) -> Callable:
    """Rows ``SCORED`` from ``PACKED`` rows: a task's best ``k`` passages of each question of ``todo``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, asked = vocabulary.value, todo.value
        best = [[(_Questions(block, kind.dense), _Best(len(block.numbers), k)) for block in kind.blocks] for kind in asked]
        places = []
        for kind in asked:
            places.append([np.full(len(terms) + 1, -1, np.int32) for _ in kind.pools])
            for of_term, (_, _, own, start) in zip(places[-1], kind.pools, strict=True):
                of_term[own] = start + np.arange(len(own))
        for batch in (b for b in batches if b.num_rows):
            for p in _unpacked(batch, terms):
                for kind, of_terms, tops in zip(asked, places, best, strict=True):
                    side = _side(kind, of_terms, p, k1, b)
                    if side is not None:
                        for questions, top in tops:
                            top.add(_Scores(questions, side))
        for questions, top in (x for tops in best for x in tops):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(questions.numbers[top.q].astype(np.int32)),
                    pa.array(top.pos, mask=top.pos == _NO_POS),
                    pa.array(top.score),
                ],
                names=["question", "pos", "score"],
            )

    return run
