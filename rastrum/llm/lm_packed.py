"""The model of ``lm`` and its scores of the texts that it was fitted on, with pairs in packed arrays.

Same restaurants, draws and results as ``lm.fit`` and ``lm.score``, for tables with up
to ``MOST_WORDS`` words.  A word's number is its place among the words sorted by id.  Words'
numbers are broadcast, and read from the executor's file of the broadcast, which its workers
share.  Each text's pairs are shuffled once, by a hash of the pair, with the text's number:
a part of some thousand texts sends one row of arrays to each partition, so that rows
don't grow with the square of the table.  There pairs are sorted and written in ``BUCKETS``
rows of arrays that hold how often each occurs in training texts
and which texts it is in, so that neither sweeps nor scoring shuffle pairs again.
Pairs of two common words, which need no number of their own, go to a partition by text
as well, so that a very frequent pair isn't in one place.

A sweep reads the rows of pairs that occur more than once, and adds up their tables
by word; words are rows of arrays too, a row for each of ``BLOCKS`` ranges of ids.
Texts' sums are added up by the text's number, which is the task's and the row's
when texts are read, once.  Words that are in no training text stay with their text
until it is scored.
"""

from __future__ import annotations

import math
import mmap
import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.serializers import pickle_protocol
from pyspark.sql import functions as F

from rastrum.llm import lm
from rastrum.llm.common import discard, materialize

#: Words whose numbers are broadcast; above, pairs are rows that are joined.
MOST_WORDS = 64 << 20
#: Ranges of ids that are a row of words each, by the id's upper six bits.
BLOCKS = 64
#: Words' numbers are broadcast in pieces, of which the driver holds one at a time: so many at least, and so many words in each at most if blocks allow it.
PIECES, PIECE = 4, 1 << 20
#: Partitions that texts' pairs are shuffled into for each shuffle partition, and rows of pairs in each.
FINER, BUCKETS = 2, 16
#: Once more texts than this are read, their pairs are sent on.
DEALT = 3 << 10
#: A text's number is that of the task that reads it, times this, and the row's.
TASK = 1 << 32
#: Pairs that are seated at once, of some rows.
SEATED = 200_000
#: A task's sums by word are sent on in parts if there are more.
SUMS = 1 << 20

_MAPPED = "bucket int, base long, first int, u binary, w binary, d binary, times binary, ids array<long>, tokens binary, known binary, plain binary, words array<binary>"
_REFS = (
    "bucket int, base long, u binary, w binary, n binary, refs binary, docs binary, d binary, times binary, ids array<long>, tokens binary, known binary, plain binary, words array<binary>, "
    "mu binary, mw binary, mn binary, cell binary, cn binary, ow binary, aw binary, ou binary, au binary, once long, twice long"
)
_SUMS = "block int, kind string, r binary, x binary"
_SEATED = f"bucket int, kept binary, {_SUMS}"
_WORDS = f"words binary, id binary, c binary, aw binary, au binary, {_SUMS}"
_LEVEL = (
    "block int, words binary, id binary, c binary, aw binary, au binary, n binary, follows binary, t binary, s binary, cell binary, cn binary, "
    "common array<long>, common_n array<long>, tables double, customers double, follow_sum double, once long, twice long"
)
_PARTS = "g int, doc binary, score binary, ids array<long>, tokens binary, known binary, plain binary"


def pack(x: np.ndarray) -> bytes:
    """How many bytes of each number follow, and the numbers' first bytes, their second bytes and so on, which compresses well; last bytes that are all zero are left out."""
    kept = max(1, (int(x.view(f"u{x.itemsize}").max(initial=0)).bit_length() + 7) // 8)
    return b"".join((bytes([kept]), np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize)[:, :kept].T)))


def unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(memoryview(data)[1:], np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view(kind).ravel()


def _steps(x: np.ndarray) -> bytes:
    """Packed differences of numbers in ascending order."""
    return pack(np.diff(x, prepend=0).astype(np.uint32))


def _sums(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint32), dtype=np.int64)


def _row(schema: pa.Schema, **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([values], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows that are next to each other and share a key."""
    held: list[dict] = []
    for row in _rows(batches):
        if held and held[0][key] != row[key]:
            yield held[0][key], held
            held = []
        held.append(row)
    if held:
        yield held[0][key], held


def _together(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(lm._buckets(df), key).sortWithinPartitions(key)


def _labels(spark: SparkSession, partitions: int) -> np.ndarray:
    """Numbers, ``BUCKETS`` for each partition, one partition's after the other's, so that Spark puts them there."""
    many, number = 4 * BUCKETS * partitions, F.col("id").cast("int")
    while True:
        grouped = spark.range(many).groupBy(F.pmod(F.hash(number), F.lit(partitions)))
        found = [r["x"] for r in grouped.agg(F.slice(F.array_sort(F.collect_list(number)), 1, BUCKETS).alias("x")).collect()]  # a row for each partition
        if len(found) == partitions and min(map(len, found)) == BUCKETS:
            return np.concatenate(found)
        many *= 2


@contextmanager
def _rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tasks read and hand to Python so many rows at a time, in jobs that run inside."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(k) for k in keys]
    for k, x in zip(keys, before, strict=True):
        spark.conf.set(k, str(min(rows, int(x)) if int(x) > 0 else rows))
    try:
        yield
    finally:
        for k, x in zip(keys, before, strict=True):
            spark.conf.set(k, x)


def block_of(ids: np.ndarray) -> np.ndarray:
    return (ids >> np.int64(58)) + BLOCKS // 2


def _bytes_of(piece: Broadcast, size: int) -> np.ndarray:
    """A broadcast's bytes, from the worker's file of it if they are found there; else the worker loads them."""
    path, head = getattr(piece, "_path", None), b"B" + (size & 0xFFFFFFFF).to_bytes(4, "little")
    if path and size < 1 << 32:
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if (at := data[:64].find(head)) >= 0 and len(data) >= at + 5 + size:
            return np.frombuffer(data, np.uint8, size, at + 5)
    return np.frombuffer(piece.value, np.uint8)


def _slack() -> int:
    """Bytes to put before numbers, so that those of a pickled broadcast start at a multiple of eight in its file."""
    x = b"x" * (1 << 17)
    return -pickle.dumps(x, pickle_protocol).index(x[:8]) % 8


class Numbers:
    """Broadcast arrays with a number for each word, in pieces by the word's place; blocks: how many words each has."""

    def __init__(self, starts: np.ndarray, sizes: list[int], kinds: tuple[type, ...], pieces: list, blocks: np.ndarray):
        self.starts, self.sizes, self.kinds, self.pieces, self.blocks = starts, sizes, kinds, pieces, blocks
        self._read: dict[int, list[np.ndarray]] = {}

    def drop(self) -> None:
        """Delete the broadcasts' files, on executors too, once nothing reads them any more."""
        self._read.clear()
        for piece in self.pieces:
            piece.destroy()

    def piece(self, k: int) -> list[np.ndarray]:
        if k not in self._read:
            n, found, at = self.sizes[k], [], _slack()
            data = _bytes_of(self.pieces[k], at + sum(_padded(n * np.dtype(x).itemsize) for x in self.kinds))
            for kind in self.kinds:
                found.append(np.frombuffer(data, kind, n, at))
                at += _padded(found[-1].nbytes)
            self._read[k] = found
        return self._read[k]

    def at(self, places: np.ndarray, which: int = 0) -> np.ndarray:
        out = np.empty(len(places), self.kinds[which])
        part = (np.searchsorted(self.starts, places, side="right") - 1).astype(np.uint8)
        for k in np.flatnonzero(np.bincount(part, minlength=1)).tolist():
            i = np.flatnonzero(part == k)
            out[i] = self.piece(k)[which][places[i] - self.starts[k]]
        return out

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Each id's place, -1 if it is none of a known word; the first array holds the ids."""
        order = np.argsort(ids)
        asked, found = ids[order], np.full(len(ids), -1, np.int64)
        cuts = np.searchsorted(block_of(asked) // (BLOCKS // len(self.pieces)), np.arange(len(self.pieces) + 1)).tolist()
        for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            own = self.piece(k)[0] if j > i else ()
            if len(own):
                at = np.minimum(np.searchsorted(own, asked[i:j]), len(own) - 1)
                found[i:j] = np.where(own[at] == asked[i:j], at + self.starts[k], -1)
        out = np.empty(len(ids), np.int64)
        out[order] = found
        return out


def _padded(size: int) -> int:
    return size + -size % 8


def _broadcast(rows: DataFrame, v: int, of: Callable[[dict], tuple], *kinds: type) -> Numbers:
    """What ``of`` gives for each row's words, of which there are v, as broadcasts; the driver holds one piece at a time."""
    many = min(BLOCKS, max(PIECES, 1 << max(0, math.ceil(math.log2(max(1, v) / PIECE)))))
    each, sizes, pieces, blocks, context = BLOCKS // many, [], [], np.zeros(BLOCKS, np.int64), rows.sparkSession.sparkContext
    for k in range(many):
        got = sorted(rows.where(F.col("block").between(k * each, (k + 1) * each - 1)).toArrow().to_pylist(), key=lambda r: r["block"])
        found = [of(r) for r in got]
        for r, f in zip(got, found, strict=True):
            blocks[r["block"]] = len(f[0])
        arrays = [np.concatenate([np.zeros(0, kind), *(f[i].astype(kind) for f in found)]) for i, kind in enumerate(kinds)]
        sizes.append(len(arrays[0]))
        pieces.append(context.broadcast(bytes(_slack()) + b"".join(x.tobytes() + bytes(-x.nbytes % 8) for x in arrays)))
    return Numbers(np.cumsum([0, *sizes[:-1]]), sizes, kinds, pieces, blocks)


def _word_blocks(words: DataFrame) -> DataFrame:
    """(block, words, id, c): words (word, id, c) sorted by id; a word has no space byte."""
    schema = _schema("block int, words binary, id binary, c binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in lm._together(batches):
            ids, c = table["id"].to_numpy(), table["c"].to_numpy()
            own, block = table["word"].to_pylist(), block_of(ids)
            for i, j in _bounds(block):
                yield _row(schema, block=int(block[i]), words=b" ".join(own[i:j]), id=ids[i:j].tobytes(), c=c[i:j].tobytes())

    placed = words.select("word", "id", "c", (F.shiftright("id", 58) + BLOCKS // 2).alias("block"))
    return placed.repartition(lm._buckets(words), "block").sortWithinPartitions("id").mapInArrow(run, "block int, words binary, id binary, c binary")


def _bounds(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where runs of equal numbers start and end."""
    if len(x):
        cuts = (np.flatnonzero(x[1:] != x[:-1]) + 1).tolist()
        yield from zip([0, *cuts], [*cuts, len(x)], strict=True)


class Kinds:
    """Classes of words by their places: common words have ids from 0 on, so their places are next to each other."""

    def __init__(self, first: int, n: int):
        self.first, self.n = first, n

    def of(self, places: np.ndarray) -> np.ndarray:
        k = places - self.first
        return np.where((k >= 0) & (k < self.n) & (places >= 0), k, self.n)


def _mapped(docs: DataFrame, held_classes, ids: Numbers, kinds: Kinds, n: int, v: int, labels: np.ndarray) -> DataFrame:
    """Of some thousand texts (id, __text) at a time a row of their pairs for each partition; for each part of these a row of what else is known of its texts.

    first: how many of the row's pairs are those of training texts, which come first."""
    schema, bits, base_log, to = _schema(_MAPPED), max(1, v.bit_length()), math.log10(n + v + 1), labels[::BUCKETS]

    def read(b: pa.RecordBatch, base: int, classes: lm.Classes) -> tuple[dict, tuple[np.ndarray, ...]]:
        """What else is known of a part's texts, and their pairs of known words: first and second word, text, times, aside."""
        doc_ids, (words, token, size) = b["id"].to_pylist(), lm.tokenized(b["__text"])
        words, end = words.to_pylist(), token[-1]
        place = ids.places(classes.names(words))
        order = np.argsort(place, kind="stable")  # a word's number is by its place, those of unknown words come first
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place, token, end, old = place[order], rank[token], rank[end], int(np.searchsorted(place[order], 0))
        starts = np.cumsum(size) - size
        known, c = np.add.reduceat((token >= old).astype(np.int64), starts), np.zeros(len(place))
        c[old:] = ids.at(place[old:], 1)
        plain = np.add.reduceat((np.log10(c + 1) - base_log)[token], starts)
        wide, deep = len(words).bit_length(), len(size).bit_length()
        key = np.append(end, token[:-1])
        key[starts] = end
        key <<= wide
        key |= token
        key <<= deep
        key |= np.repeat(np.arange(len(size)), size)
        key.sort()
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        times, key = np.diff(np.append(at, len(key))).astype(np.uint32), key[at]
        d, w, u = (key & ((1 << deep) - 1)).astype(np.uint16), key >> deep & ((1 << wide) - 1), key >> (wide + deep)
        new = np.minimum(u, w) < old
        x = np.flatnonzero(new)
        more = {"ids": doc_ids, "tokens": pack(size.astype(np.uint32)), "known": pack(known.astype(np.uint32)), "plain": plain.tobytes(), "words": [words[order[i]] for i in w[x][w[x] < old].tolist()]}
        of_new = {"u": pack((place[u[x]] + 1).astype(np.uint32)), "w": pack((place[w[x]] + 1).astype(np.uint32)), "d": pack(d[x]), "times": pack(times[x])}
        x = np.flatnonzero(~new)
        place, aside = place.astype(np.uint32), np.array([lm.held_out(i) for i in doc_ids])
        return {"bucket": int(to[base % len(to)]), "base": base, **of_new, **more}, (place[u[x]], place[w[x]], d[x], times[x], aside[d[x]])

    def dealt(base: int, pairs: list[tuple[np.ndarray, ...]]) -> Iterator[dict]:
        u, w, d, times, aside = (np.concatenate(x) for x in zip(*pairs, strict=True))
        pairs.clear()
        part = lm.mixed(u.astype(np.uint64) << np.uint64(bits) | w)
        part += np.where((kinds.of(u) < kinds.n) & (kinds.of(w) < kinds.n), d + np.int64(base), 0).astype(np.uint64)
        part = (part % np.uint64(len(to))).astype(np.int64) << 1 | aside
        order = np.argsort(part << 32 | u)
        part, u, w, d, times = (x[order] for x in (part, u, w, d, times))
        del order
        firsts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))[: len(part)]
        step = np.diff(u, prepend=np.uint32(0))
        step[firsts] = u[firsts]
        for i, j in _bounds(part >> 1):
            yield {"bucket": int(to[part[i] >> 1]), "base": base, "first": int(np.searchsorted(part[i:j] & 1, 1)), "u": pack(step[i:j]), "w": pack(w[i:j]), "d": pack(d[i:j]), "times": pack(times[i:j])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, at, pairs = TaskContext.get().partitionId() * TASK, 0, []
        for b in lm.parts_of(batches):
            head, (u, w, d, *more) = read(b, row + at, held_classes.value)
            yield pa.RecordBatch.from_pylist([head], schema=schema)
            pairs.append((u, w, d + np.uint16(at), *more))
            at += b.num_rows
            del u, w, d, more
            if at > DEALT:
                yield from few(dealt(row, pairs))
                row, at = row + at, 0
        if pairs:
            yield from few(dealt(row, pairs))

    def few(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        while some := list(islice(rows, 64)):
            yield pa.RecordBatch.from_pylist(some, schema=schema)

    return docs.select("id", "__text").mapInArrow(run, _MAPPED)


def _by_pair(mapped: DataFrame, kinds: Kinds, v: int, labels: np.ndarray) -> DataFrame:
    """``BUCKETS`` rows for each partition: pairs, how often each occurs in training texts, and its texts."""
    schema, bits, size = _schema(_REFS), max(1, v.bit_length()), kinds.n + 1
    of = {int(x[0]): x.tolist() for x in labels.reshape(-1, BUCKETS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for b in batches:
            rows = {c: b[c].to_pylist() for c in _schema(_MAPPED).names[:7]}
            for i, first in enumerate(rows["first"]):
                if first is None:
                    yield _row(schema, **b.slice(i, 1).select([c for c in _schema(_MAPPED).names if c != "first"]).to_pylist()[0])
                else:
                    u = _sums(rows["u"][i])
                    if first:
                        u[first:] -= u[first - 1]
                    times = unpack(rows["times"][i], np.uint32)
                    held.setdefault(rows["bucket"][i], []).append((u << bits | unpack(rows["w"][i], np.uint32), unpack(rows["d"][i], np.uint16) + np.int64(rows["base"][i]), times, first))
        for bucket in list(held):
            rows = held.pop(bucket)
            key, doc, times = (np.concatenate([r[i] for r in rows]) for i in range(3))
            counted = np.concatenate([np.where(np.arange(len(r[2])) < r[3], r[2], 0) for r in rows])
            del rows
            order = np.argsort(key)
            key, doc, times, counted = key[order], doc[order], times[order], counted[order]
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            cuts = np.searchsorted(starts, [len(key) * k // BUCKETS for k in range(BUCKETS)]).tolist()
            for label, i, j in zip(of[bucket], cuts, [*cuts[1:], len(starts)], strict=True):
                if j > i:
                    a, z = int(starts[i]), int(starts[j]) if j < len(starts) else len(key)
                    yield _pairs_row(label, key[starts[i:j]], np.add.reduceat(counted[a:z], starts[i:j] - a), np.diff(np.append(starts[i:j], z)), doc[a:z], times[a:z])

    def _pairs_row(label: int, key: np.ndarray, n: np.ndarray, refs: np.ndarray, doc: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        u, w = key >> bits, key & ((1 << bits) - 1)
        ku, kw = kinds.of(u), kinds.of(w)
        asked = (ku == kinds.n) | (kw == kinds.n)
        multi, once = asked & (n > 1), asked & (n == 1)
        at = (ku < kinds.n) & (n > 0)
        cell, inverse = np.unique(ku[at] * size + kw[at], return_inverse=True)
        (ow, aw), (ou, au) = (np.unique(x[once], return_counts=True) for x in (w, u))
        return _row(
            schema, bucket=label, u=_steps(u), w=pack(w.astype(np.uint32)), n=pack(n.astype(np.int64)), refs=pack(refs.astype(np.uint32)), docs=pack(doc), times=pack(times),
            mu=_steps(u[multi]), mw=pack(w[multi].astype(np.uint32)), mn=pack(n[multi].astype(np.int64)), cell=pack(cell.astype(np.int32)), cn=pack(np.bincount(inverse, weights=n[at], minlength=len(cell)).astype(np.int64)),
            ow=_steps(ow), aw=pack(aw), ou=_steps(ou), au=pack(au), once=int(once.sum()), twice=int((asked & (n == 2)).sum()),
        )

    return mapped.repartition(FINER * lm._buckets(mapped), "bucket").mapInArrow(run, _REFS)


def _cells(rows: DataFrame) -> DataFrame:
    """(cell, n) of rows of arrays cell and cn, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Sums()
        for r in _rows(batches):
            if r["cell"]:
                found.add(unpack(r["cell"], np.int32), unpack(r["cn"], np.int64))
        if found.held:
            cell, n = found.merged()
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])  # COMMON ** 2 or 256 ** 3 at most

    return rows.select("cell", "cn").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


class Sums:
    """Sums by number."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, at: np.ndarray, x: np.ndarray) -> None:
        self.held.append((at, x))
        self.waiting += len(at)
        if self.waiting > SUMS:
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        at, x = (np.concatenate(y) for y in zip(*self.held, strict=True))
        order = np.argsort(at)
        at = at[order]
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, int)
        self.held = [(at[starts], np.add.reduceat(x[order], starts) if len(at) else x)]
        self.waiting = len(starts)
        return self.held[0]


def _sums_rows(found: dict[str, Sums], limits: np.ndarray, schema: pa.Schema, least: int = 0) -> Iterator[pa.RecordBatch]:
    """A row for each kind of sums and block, of sums of more than so many words; r: places from the block's first on."""
    for kind, sums in found.items():
        if sums.held and sums.waiting > least:
            at, x = sums.merged()
            cuts = np.searchsorted(at, limits).tolist()
            for block, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if j > i:
                    yield _row(schema, block=block, kind=kind, r=_steps(at[i:j] - limits[block]), x=pack(x[i:j]))
            found[kind] = Sums()


def _counted_pairs(refs: DataFrame, ids: Numbers) -> DataFrame:
    """Sums by word, before the first sweep: of pairs that occur once, and a table for each that occurs more often."""
    schema, limits = _schema(_SUMS), _limits(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {kind: Sums() for kind in ("aw", "au", "tw", "tu")}
        for r in _rows(batches):
            if r["mu"] is not None:
                for kind, at in (("aw", "ow"), ("au", "ou")):
                    found[kind].add(_sums(r[at]), unpack(r[kind], np.int64))
                for kind, at in (("tw", unpack(r["mw"], np.uint32).astype(np.int64)), ("tu", _sums(r["mu"]))):
                    found[kind].add(at, np.ones(len(at), np.int64))
                yield from _sums_rows(found, limits, schema, SUMS // 2)
        yield from _sums_rows(found, limits, schema)

    return refs.select("mu", "mw", "ow", "aw", "ou", "au").mapInArrow(run, _SUMS)


def _seat_pairs(refs: DataFrame, numbers: Numbers, ids: Numbers, kinds: Kinds, row: np.ndarray, discount: float, k: int, keep: bool) -> DataFrame:
    """After a sweep: the tables of each row's pairs (bucket, kept) if they are kept, and their sums by word."""
    schema, row, limits = _schema(_SEATED), row.tolist(), _limits(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, waiting = {kind: Sums() for kind in ("tw", "tu")}, [], 0
        for r in _rows(batches):
            if r["mu"] is not None:
                held.append((r["bucket"], _sums(r["mu"]), unpack(r["mw"], np.uint32).astype(np.int64), unpack(r["mn"], np.int64)))
                waiting += len(held[-1][1])
                if waiting > SEATED:
                    yield from seated(held, found)
                    held, waiting = [], 0
        if held:
            yield from seated(held, found)
        yield from _sums_rows(found, limits, schema)

    def seated(held: list[tuple], found: dict[str, Sums]) -> Iterator[pa.RecordBatch]:
        of, (u, w, n) = np.array(row), (np.concatenate([r[i] for r in held]) for i in (1, 2, 3))
        ku, kw = kinds.of(u), kinds.of(w)
        parent = np.where(kw == kinds.n, numbers.at(w), 1.0) * np.where(ku == kinds.n, of[kw], 1.0)
        keys = lm.mixed(ids.at(u).view(np.uint64) ^ lm.mixed(ids.at(w).view(np.uint64), 6), 5, k)
        t = lm.seats(n, (lm.STRENGTH + discount * numbers.at(u, 1)) * parent, discount, keys).astype(np.int64)
        found["tw"].add(w, t)
        found["tu"].add(u, t)
        ends = np.cumsum([len(r[1]) for r in held]).tolist() if keep else ()
        for (bucket, *_), i, j in zip(held, [0, *ends], ends, strict=False):
            yield _row(schema, bucket=bucket, kept=pack(t[i:j]))
        yield from _sums_rows(found, limits, schema, SUMS // 2)

    return refs.select("bucket", "mu", "mw", "mn").mapInArrow(run, _SEATED)


def _limits(ids: Numbers) -> np.ndarray:
    """The place that each block starts at, and the number of words."""
    return np.append(0, np.cumsum(ids.blocks))


def _seat_words(blocks: DataFrame, sums: DataFrame, n_common: int, seed: int, held: Broadcast, below: float, tables: float, k: int) -> DataFrame:
    """Rows of words after a sweep of the restaurant of uncommon words; sweep 0 has a table for each."""
    schema = _schema(_LEVEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _runs(batches, "block"):
            own = next(r for r in rows if r["words"] is not None)
            words, ids = own["words"].split(b" "), np.frombuffer(own["id"], np.int64)
            found = {c: np.zeros(len(ids), np.int64) if own[c] is None else unpack(own[c], np.int64).copy() for c in ("aw", "au")} | {c: np.zeros(len(ids), np.int64) for c in ("tw", "tu")}
            for r in rows:
                if r["r"] is not None:
                    found[r["kind"]][_sums(r["r"])] += unpack(r["x"], np.int64)
            n, follows = found["aw"] + found["tw"], found["au"] + found["tu"]
            common = (ids >= 0) & (ids < n_common)
            rare, t, (cells, starts) = ~common, np.ones(len(ids)), lm.cells_of(words)
            s = lm.spelled_cells(cells, starts, held.value)
            if k:
                keys = ids[rare].view(np.uint64) if not seed else lm.hashes_of([x for x, y in zip(words, rare.tolist(), strict=True) if y])
                t[rare] = lm.seats(n[rare], (lm.STRENGTH + below * tables) * 10.0 ** s[rare], below, lm.mixed(keys, k))
            t = np.where(rare, t, 0).astype(np.int64)
            cell, weight = _spelled_cells(cells, starts, t)
            yield _row(
                schema, block=block, words=own["words"], id=own["id"], c=own["c"], aw=pack(found["aw"]), au=pack(found["au"]), n=pack(n), follows=pack(follows), t=pack(t), s=s.tobytes(),
                cell=pack(cell), cn=pack(weight), common=ids[common].tolist(), common_n=n[common].tolist(),
                tables=float(t[rare].sum()), customers=float(n[rare].sum()), follow_sum=float(follows[rare].sum()), once=int((n[rare] == 1).sum()), twice=int((n[rare] == 2).sum()),
            )

    wide = _schema(_WORDS).names
    of = blocks.select("block", *(c if c in blocks.columns else F.lit(None).cast("binary").alias(c) for c in wide[:5]), F.lit(None).cast("string").alias("kind"), *(F.lit(None).cast("binary").alias(c) for c in "rx"))
    return _blockwise(of.unionByName(sums.select("block", *(F.lit(None).cast("binary").alias(c) for c in wide[:5]), "kind", "r", "x"))).mapInArrow(run, _LEVEL)


def _blockwise(df: DataFrame) -> DataFrame:
    return df.repartition(min(BLOCKS, lm._buckets(df)), "block").sortWithinPartitions("block")


def _spelled_cells(cells: np.ndarray, starts: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the words' tables, spelled, and how often they occur: those of words with one table, then all others'."""
    weight = np.repeat(t, np.diff(np.append(starts, len(cells))))
    once, n = np.unique(cells[weight == 1], return_counts=True)
    more, inverse = np.unique(cells[weight > 1], return_inverse=True)
    return np.concatenate([once, more]).astype(np.int32), np.concatenate([n, np.bincount(inverse, weights=weight[weight > 1], minlength=len(more))]).astype(np.int64)


def _word_numbers(told: DataFrame, v: int, count: type, below: float, customers: float, back: float) -> Numbers:
    """An uncommon word's probability, and tables of what follows."""

    def of(r: dict) -> tuple[np.ndarray, np.ndarray]:
        n, t, s = unpack(r["n"], np.int64), unpack(r["t"], np.int64), np.frombuffer(r["s"])
        return np.maximum((n - below * t) / (lm.STRENGTH + customers), 0.0) + back * 10.0**s, unpack(r["follows"], np.int64)

    return _broadcast(told.select("block", "n", "t", "s", "follows"), v, of, float, count)


def _averaged(levels: list[tuple[DataFrame, float, float]], n_common: int, log_probability: Callable) -> DataFrame:
    """(block, log10 of an uncommon word's probability, added-up tables of what follows, count in training texts) over the kept sweeps."""
    schema = _schema("block int, a0 binary, a1 binary, a2 binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _runs(batches, "block"):
            ids = np.frombuffer(rows[0]["id"], np.int64)
            common = (ids >= 0) & (ids < n_common)
            own = sum((unpack(r["n"], np.int64) - r["below"] * unpack(r["t"], np.int64)) / (lm.STRENGTH + r["among"]) for r in rows) / len(rows)
            follows = sum(unpack(r["follows"], np.int64) for r in rows)
            p = log_probability(rows[0]["words"].split(b" "), np.where(common, 0.0, own))
            yield _row(schema, block=block, a0=np.where(common, 0.0, p).tobytes(), a1=follows.tobytes(), a2=rows[0]["c"])

    every = None
    for told, below, customers in levels:
        one = told.select("block", "words", "id", "c", "n", "t", "follows", F.lit(float(below)).alias("below"), F.lit(float(customers)).alias("among"))
        every = one if every is None else every.unionByName(one)
    return _blockwise(every).mapInArrow(run, "block int, a0 binary, a1 binary, a2 binary")


def _scored(refs: DataFrame, model: lm.Model, numbers: Numbers, kinds: Kinds, samples: int) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of rows of pairs with their kept tables."""
    of, back_off, discount = model.log_probability(), model.back_off(), model.discount
    groups, schema, kept = lm._buckets(refs), _schema(_PARTS), [c for c in refs.columns if c.startswith("kept")]

    def shares(doc: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Sums by text, a row for each group of texts."""
        order = np.argsort(doc)
        doc = doc[order]
        starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        doc, score = doc[starts], np.add.reduceat(score[order], starts)
        group = _group(doc, groups)
        order = np.argsort(group, kind="stable")
        group, doc, score = group[order], doc[order], score[order]
        for i, j in _bounds(group):
            yield _row(schema, g=int(group[i]), doc=pack(np.diff(doc[i:j], prepend=0)), score=score[i:j].tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for r in _rows(batches):
            if r["ids"] is not None:
                size = len(r["ids"])
                doc, tokens, known, plain = r["base"] + np.arange(size), unpack(r["tokens"], np.uint32), unpack(r["known"], np.uint32), np.frombuffer(r["plain"])
                group = _group(doc, groups)
                for g in np.unique(group).tolist():
                    i = np.flatnonzero(group == g)
                    yield _row(schema, g=g, doc=pack(doc[i]), ids=[r["ids"][x] for x in i.tolist()], tokens=pack(tokens[i]), known=pack(known[i]), plain=plain[i].tobytes())
                u, w = (unpack(r[c], np.uint32).astype(np.int64) - 1 for c in "uw")
                if not len(u):
                    continue
                doc, times = unpack(r["d"], np.uint16) + np.int64(r["base"]), unpack(r["times"], np.uint32).astype(float)
                p, follows, cu = (np.zeros(len(u)) for _ in range(3))
                old, after = w >= 0, u >= 0
                p[old] = numbers.at(w[old])
                follows[after], cu[after] = numbers.at(u[after], 1) / samples, numbers.at(u[after], 2)
                p[~old] = of(r["words"], np.zeros(len(r["words"])))
                q, _ = back_off(kinds.of(u), kinds.of(w), p, cu, follows)
            else:
                u, w, n = _sums(r["u"]), unpack(r["w"], np.uint32).astype(np.int64), unpack(r["n"], np.int64)
                ku, kw = kinds.of(u), kinds.of(w)
                q, z = back_off(ku, kw, numbers.at(w), numbers.at(u, 2), numbers.at(u, 1) / samples)
                asked = (ku == kinds.n) | (kw == kinds.n)
                t, at = np.ones(len(u)), np.flatnonzero(asked & (n > 0))
                if (multi := asked & (n > 1)).any():
                    t[multi] = sum(unpack(r[c], np.int64) for c in kept) / samples
                own, z = n[at] - discount * t[at], z[at]
                with np.errstate(over="ignore"):
                    q[at] += np.where(z > -300, np.log1p(own * 10.0 ** -np.maximum(z, -300)) / math.log(10), np.log10(own) - z)
                refs = unpack(r["refs"], np.uint32)
                doc, times = unpack(r["docs"], np.int64), unpack(r["times"], np.uint32).astype(float)
                q = np.repeat(q, refs)
            held.append((doc, times * q))
            waiting += len(doc)
            if waiting > 1_200_000:
                yield from shares(*map(np.concatenate, zip(*held, strict=True)))
                held, waiting = [], 0
        if held:
            yield from shares(*map(np.concatenate, zip(*held, strict=True)))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches, "g"):
            heads = [r for r in rows if r["ids"] is not None]
            doc, tokens, known = (np.concatenate([unpack(r[c], kind) for r in heads]) for c, kind in (("doc", np.int64), ("tokens", np.uint32), ("known", np.uint32)))
            ids, order = pa.array([x for r in heads for x in r["ids"]], pa.int64()), np.argsort(doc)
            plain, score = np.concatenate([np.frombuffer(r["plain"]) for r in heads]), np.zeros(len(doc))
            for r in rows:
                if r["ids"] is None:
                    at = order[np.searchsorted(doc, np.cumsum(unpack(r["doc"], np.int64)), sorter=order)]
                    score[at] += np.frombuffer(r["score"])
            yield pa.RecordBatch.from_arrays([ids, pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(plain), pa.array(score)], names=lm._SCORED)

    return _together(refs.mapInArrow(run, _PARTS), "g").mapInArrow(add_up, "id long, n_tokens long, n_known long, base_score double, score double")


def _group(doc: np.ndarray, groups: int) -> np.ndarray:
    return (lm.mixed(doc >> 8) % np.uint64(groups)).astype(np.int64)


def score(docs: DataFrame, every: DataFrame, burn_in: int = lm.BURN_IN, samples: int = lm.SAMPLES, most_common: int = lm.COMMON) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score, train_tokens) of documents (id, __text); every: their ``lm.word_counts``."""
    context = docs.sparkSession.sparkContext
    n, v = (x or 0 for x in every.agg(F.sum("c"), F.count("*")).first())
    common = [bytes(r["word"]) for r in every.orderBy(F.desc("c"), "word").limit(most_common).collect()]  # most_common rows
    words, classes = lm.named_words(every, common)
    blocks, size, spelling = materialize(_word_blocks(words), "blocks"), classes.n + 1, lm.Spelling()
    discard(words)
    count = np.uint32 if n * samples < 1 << 32 else np.int64
    ids = _broadcast(blocks.select("block", "id", "c"), v, lambda r: (np.frombuffer(r["id"], np.int64), np.frombuffer(r["c"], np.int64)), np.int64, count)
    kinds = Kinds(int(ids.blocks[: BLOCKS // 2].sum()), classes.n)
    labels = _labels(docs.sparkSession, FINER * lm._buckets(docs))
    mapped = _mapped(docs, context.broadcast(classes), ids, kinds, n, v, labels)
    with _rows_at_once(docs.sparkSession, 64):
        refs = lm._in_buckets(_by_pair(mapped, kinds, v, labels), "refs", "bucket")
    counts = materialize(_cells(refs), "classes")
    alone = np.zeros(size)
    for r in counts.where(F.col("cell") % size == classes.n).collect():  # COMMON rows
        alone[r["cell"] // size] = r["n"]
    discount = lm.discount_of(*(x or 0 for x in refs.agg(F.sum("once"), F.sum("twice")).first()))
    kept, told, numbers, row, tables, below = [], blocks, None, None, 0.0, 0.5
    class_model, follow, levels, sweeps = lm.ClassModel(counts, size), np.zeros((size, size)), [], []
    for k in range(burn_in + samples + 1):
        seated = materialize(_seat_pairs(refs, numbers, ids, kinds, row, discount, k, k > burn_in) if k else _counted_pairs(refs, ids), "seated")
        if k:
            numbers.drop()
        logs = context.broadcast(spelling.logs)  # as in lm._seat_words
        before, told = told, materialize(_seat_words(told, seated.where("block IS NOT NULL"), classes.n, classes.seed, logs, below, tables, k), "level")
        logs.destroy()
        if k <= burn_in:
            discard(seated)
        else:
            kept.append(seated)
        if k <= burn_in + 1:
            discard(before)
        stats = told.agg(*(F.sum(c) for c in ("tables", "customers", "follow_sum", "once", "twice"))).first()
        tables, customers, left = (float(x or 0) for x in stats[:3])
        if not k:
            below = lm.discount_of(*(x or 0 for x in stats[3:]))
        back = (lm.STRENGTH + below * tables) / (lm.STRENGTH + customers)
        spelling.sweep(_cells(told), k)
        shared = np.zeros(size)
        for r in told.where(F.size("common") > 0).select("common", "common_n").collect():  # COMMON numbers
            shared[r["common"]] = r["common_n"]
        shared[classes.n] = left - shared.sum()
        found = class_model.sweep(shared, k)
        row = found[classes.n]
        if k > burn_in:
            follow += found / samples
            sweeps.append((spelling.logs, back))
            levels.append((told, below, customers))
        if k < burn_in + samples:
            numbers = _word_numbers(told, v, count, below, customers, back)
    model = lm.Model(blocks, n, v, sweeps, classes, follow, refs, refs, discount, alone)
    averaged = materialize(_averaged(levels, classes.n, model.log_probability()), "averaged")
    ids.drop()
    numbers = _broadcast(averaged, v, lambda r: tuple(np.frombuffer(r[c], kind) for c, kind in (("a0", float), ("a1", np.int64), ("a2", np.int64))), float, count, count)
    rows = refs.select("bucket", "base", "u", "w", "n", "refs", "docs", "d", "times", "ids", "tokens", "known", "plain", "words")
    for i, seated in enumerate(kept):
        rows = rows.join(seated.where("bucket IS NOT NULL").select("bucket", F.col("kept").alias(f"kept{i}")).hint("shuffle_hash"), "bucket", "left")
    with _rows_at_once(docs.sparkSession, 4):  # rows of some megabytes
        out = materialize(_scored(rows, model, numbers, kinds, samples), "scores")
    numbers.drop()
    lm._drop(refs)
    discard(averaged, *kept, counts, *(x for x, _, _ in levels))
    return out.withColumn("train_tokens", F.lit(n).cast("long"))
