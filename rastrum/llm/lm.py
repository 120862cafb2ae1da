"""Language-model scoring with a hierarchical Pitman-Yor model.

Every word has a restaurant for what follows it; the end of a text, a word of no
bytes, is also what stands before its first word.  The ``COMMON`` most frequent
words are classes of their own, all other words share one, and each class has a
restaurant for the class that follows it.  Which class follows a common word is drawn
from its class's restaurant, and a word that isn't common then from the word's own
restaurant, whose tables send customers to the restaurant of uncommon words.  What
follows any other word is drawn from its own restaurant over all words; a table sends
a customer to the shared class's restaurant and, if its dish isn't common, one to the
restaurant of uncommon words.  The tables of the classes' restaurants send customers
to one restaurant without context, which all share as their parent, over an even
distribution of the classes.  So all pairs of words are counted: ``COMMON`` only
tells which of them are numbers in a broadcast table and which are rows.

A table of the restaurant of uncommon words, the n-th time that a word is newly drawn, sends one customer for each
of the word's bytes down the spelling restaurants: the one for the two bytes
before, whose tables send customers to that for one byte before (shared by all
contexts that end so), then to the one without context, over the uniform
distribution of 256 bytes.  A word ends with a space byte.  Every text has a
positive probability, with known words or not.

Seatings are sampled by Gibbs sweeps.  In a sweep all customers of a dish leave
and are seated again, one after the other: a new table with weight
(strength + discount * tables) * P(dish in the parent), an old one with weight
customers - discount * tables of the dish.  A restaurant's number of tables is
that of the sweep or pass before.  From ``SEATED`` customers of a dish on, the
customers between two new tables are passed over by thinning, which draws from the
same distribution.  Every draw is a hash of the dish, its restaurant, the sweep and
the draw's number, so that partitions don't matter.  A pair of words that occurs
once has one table and isn't drawn.  After ``BURN_IN`` sweeps those of ``SAMPLES``
sweeps are averaged: each class's and word's probabilities and the pairs' tables.

The class model has at most (COMMON + 1) ** 2 probabilities and the spelling model
257 * 256 * 256 by construction; both are broadcast.  ``lm_packed`` has the same
model for up to 64 Mi words.  Here, word probabilities are
broadcast (28 bytes each) up to ``MOST_WORDS`` words, in ``PIECES`` pieces, of
which the driver holds one at a time; above, tokens are joined with
the table instead, with the same result.  Pairs are never broadcast: texts' pairs
are joined with those counted, which are stored in buckets by pair so that only the
texts' side is shuffled, a ``SLICES``-th of the texts at a time.  Counts are over all
training texts.

Defined results: a null text is empty: one end token; a null id is never held
out; repeated rows stay and count as often as they occur; of words that occur
equally often the smallest bytes are common first; without training texts all
mass is with the base distributions; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.llm.common import discard, in_parts, materialize, new_path, texts_of, with_row_key

BURN_IN, SAMPLES = 2, 2
STRENGTH = 1.0
#: Discounts of the spelling restaurants without, with one and with two bytes of context.
SPELLING_DISCOUNTS = (0.2, 0.4, 0.6)
SEATED = 64
#: Words that are classes of their own; the pairs of all others are rows.
COMMON = 1024
#: From so many training tokens on, texts are scored in so many jobs, one after the other.
SLICED, SLICES = 16 << 20, 4
MOST_WORDS = 8 << 20
#: Word probabilities are broadcast in so many pieces, by the hash's upper four bits.
PIECES = 16
SEED = 11
FOLDS, HELD_OUT = 7, 2
_END = 0x20


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), b""]


def tokenized(texts: pa.StringArray) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """(different words, each token's number among them, tokens of each text): all texts' ``tokens_of``, one after the other."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null("")))
    lists = pc.ascii_split_whitespace(trimmed)
    coded = lists.flatten().dictionary_encode()
    words, size = coded.dictionary.cast(pa.binary()), np.diff(lists.offsets.to_numpy())
    ended = pc.binary_length(trimmed).to_numpy() == 0  # an empty text is split into its end
    end = words.index(b"").as_py()
    if end < 0:
        end, words = len(words), pa.concat_arrays([words, pa.array([b""], pa.binary())])
    size = size + ~ended
    own = np.ones(int(size.sum()), bool)
    own[(np.cumsum(size) - 1)[~ended]] = False
    token = np.full(len(own), end, np.int32)
    token[own] = coded.indices.to_numpy()
    return words, token, size


def parts_of(batches: Iterator[pa.RecordBatch], rows: int = 2048, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches' rows in batches of so many rows at most, and of so many bytes of text if it isn't one row."""
    held: list[pa.RecordBatch] = []
    n = full = 0
    for b in batches:
        ends = np.cumsum(pc.binary_length(b["__text"]).fill_null(0).to_numpy().astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            more = min(rows - n, int(np.searchsorted(ends, before + size - full, side="right")) - at)
            if more > 0 or not held:
                held.append(b.slice(at, more := max(1, more)))
                n, at, full = n + more, at + more, full + int(ends[at + more - 1]) - before
            else:
                yield pa.concat_batches(held)
                held, n, full = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def stirred(x: np.ndarray, k: int) -> np.ndarray:
    """One round of ``mixed``, of unsigned numbers."""
    x = x + np.uint64((k * 0x9E3779B97F4A7C15 + SEED) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mixed(x: np.ndarray, *more: int) -> np.ndarray:
    """Well-mixed 64-bit numbers of numbers."""
    x = x.astype(np.uint64)
    for k in (0, *more):
        x = stirred(x, k)
    return x


def drawn(keys: np.ndarray, number: int) -> np.ndarray:
    """Draw of that number of each key, which has had a round of ``mixed``; above 0 and below 1."""
    return ((stirred(keys, number) >> np.uint64(12)).astype(float) + 0.5) / 2.0**52


def seats(customers: np.ndarray, weight: np.ndarray, discount: float, keys: np.ndarray) -> np.ndarray:
    """Tables of each dish after its customers sat down in turn; weight is that of a new table."""
    order = np.argsort(-customers, kind="stable")
    c, a, k = customers[order], weight[order], mixed(keys[order])
    t = np.ones(len(c))
    active = len(c)
    for i in range(1, SEATED):
        active = int(np.searchsorted(-c[:active], -i, side="left"))  # those with more than i customers
        if not active:
            break
        old = i - discount * t[:active]
        t[:active] += drawn(k[:active], i) * (a[:active] + old) < a[:active]
    left = np.arange(int(np.searchsorted(-c, -SEATED, side="left")))
    n, number = np.full(len(left), float(SEATED)), SEATED
    while len(left):
        # until it is taken, the chance of a new table only falls: jump by the chance now, then thin
        all_ = a[left] + n - discount * t[left]
        at = n + np.floor(np.log(drawn(k[left], number)) / np.log1p(-a[left] / all_))
        taken = (at < c[left]) & (drawn(k[left], number + 1) * (all_ + at - n) < all_)
        t[left] += taken
        n, number = at + 1, number + 2
        more = n < c[left]
        left, n = left[more], n[more]
    out = np.empty(len(c))
    out[order] = t
    return out


def cells_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each symbol: two bytes of context and the byte; where each word starts)."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(size) - size
    s = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.int32)
    one = np.append(np.int32(_END), s[:-1])
    two = np.append(np.int32(_END), one[:-1])
    two[starts] = _END
    return two << 16 | one << 8 | s, starts


def spelled(words: list[bytes], logs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of the words' spelling probabilities; logs: each context's row, and the rows."""
    if not words:
        return np.zeros(0)
    return spelled_cells(*cells_of(words), logs)


def spelled_cells(cells: np.ndarray, starts: np.ndarray, logs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    rows, values = logs
    return np.add.reduceat(values[rows[cells >> 8], cells & 0xFF].astype(np.float64), starts)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over documents (id, __text), held-out ones left out.

    A task's words are shuffled as rows of arrays: the words of a part by hash, their lengths and counts."""
    parts = 2 * _buckets(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[pa.Table] = []
        for b in parts_of(batches):
            texts = b["__text"].filter(pa.array([not held_out(i) for i in b["id"].to_pylist()], pa.bool_()))
            if len(texts):
                words, token, _ = tokenized(texts)
                found.append(pa.table({"word": words, "c": np.bincount(token, minlength=len(words))}))
            if sum(map(len, found)) > 600_000:
                found = [_counted(found)]
                if len(found[0]) > 300_000:
                    yield _by_part(found.pop(), parts)
        if found:
            yield _by_part(_counted(found), parts)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[pa.Table]] = {}
        for b in batches:
            for part, words, sizes, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                ends = np.cumsum(np.frombuffer(sizes, np.int32), dtype=np.int32)
                own = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(np.int32(0), ends)), pa.py_buffer(words)])
                found.setdefault(part, []).append(pa.table({"word": own, "c": np.frombuffer(c, np.int64)}))
        for part in list(found):
            yield from _counted(found.pop(part)).to_batches()

    packed = docs.select("id", "__text").mapInArrow(run, "part int, words binary, sizes binary, c binary")
    return packed.repartition(_buckets(docs), "part").mapInArrow(add_up, "word binary, c long")


def _counted(found: list[pa.Table]) -> pa.Table:
    """The tables' words, once each."""
    return pa.concat_tables(found).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"]).combine_chunks()


def _by_part(counted: pa.Table, parts: int) -> pa.RecordBatch:
    words, c = counted["word"].combine_chunks(), counted["c"].to_numpy()
    part = _parted(words, parts)
    order = np.argsort(part, kind="stable")
    part, c, words = part[order], c[order], words.take(pa.array(order))
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)
    data, cuts = memoryview(words.buffers()[2] or b""), [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    rows = [(int(part[i]), bytes(data[ends[i] : ends[j]]), np.diff(ends[i : j + 1]).tobytes(), c[i:j].tobytes()) for i, j in zip(cuts, cuts[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], names=["part", "words", "sizes", "c"])


def _parted(words: pa.BinaryArray, parts: int) -> np.ndarray:
    """A part for each word, by its bytes and where in the word they are."""
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    place = np.arange(len(data)) - np.repeat(ends[:-1], np.diff(ends))
    sums = np.append(np.uint64(0), np.cumsum(mixed(np.arange(256), 7)[data] * (mixed(np.arange(64), 8) | np.uint64(1))[place & 63]))
    return (mixed(sums[ends[1:]] - sums[ends[:-1]]) % np.uint64(parts)).astype(np.int64)


def hashes_of(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _seat_words(level: DataFrame, logs: tuple, discount: float, tables: float, sweep: int) -> DataFrame:
    """The level with t and s, the log10 of the spelling, after a sweep of the restaurant of uncommon words; sweep 0 has a table for each."""
    held = level.sparkSession.sparkContext.broadcast(logs)  # 257 * 256 rows of 256 numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b["word"].to_pylist()
            if own:
                s, rare = spelled(own, held.value), ~b["common"].to_numpy(zero_copy_only=False)
                n, t = b["n"].to_numpy(zero_copy_only=False), np.ones(len(own))
                if sweep:
                    t[rare] = seats(n[rare], (STRENGTH + discount * tables) * 10.0 ** s[rare], discount, mixed(hashes_of([w for w, r in zip(own, rare) if r]), sweep))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(rare, t, 0).astype(np.int64)), pa.array(s)], names=[*b.schema.names, "t", "s"])

    return level.mapInArrow(run, "word binary, id long, c long, common boolean, n long, follows long, t long, s double")


def _spelling_customers(seated: DataFrame) -> DataFrame:
    """(cell, n): the words' tables, spelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b["word"].to_pylist()
            if own:
                cells, starts = cells_of(own)
                weight = np.repeat(b["t"].to_numpy(zero_copy_only=False), np.diff(np.append(starts, len(cells))))
                at, inverse = np.unique(cells, return_inverse=True)
                n = np.bincount(inverse, weights=weight)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n.astype(np.int64))], names=["cell", "n"])

    return seated.select("word", "t").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _seat_contexts(customers: DataFrame, parent: np.ndarray, discount: float, sweep: int) -> DataFrame:
    """(cell, n, t): every restaurant with two bytes of context is seated in one task."""
    held = customers.sparkSession.sparkContext.broadcast(parent)  # 2 ** 16 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _together(batches):
            cell, n = table["cell"].to_numpy(), table["n"].to_numpy()
            t = seat_restaurants(cell >> 8, n, held.value[cell & 0xFFFF], discount, mixed(cell, 2, sweep))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n), pa.array(t.astype(np.int64))], names=["cell", "n", "t"])

    # 256 ** 3 rows at most over all tasks
    return customers.repartition(F.shiftright("cell", 8)).sortWithinPartitions("cell").mapInArrow(run, "cell int, n long, t long")


def seat_restaurants(room: np.ndarray, n: np.ndarray, parent: np.ndarray, discount: float, keys: np.ndarray) -> np.ndarray:
    """Tables of each dish; parent: its probability there.  Two passes, the first with a table for each dish."""
    _, room = np.unique(room, return_inverse=True)
    tables = np.bincount(room).astype(float)
    for k in range(2):
        t = seats(n, (STRENGTH + discount * tables[room]) * parent, discount, mixed(keys, k))
        tables = np.bincount(room, weights=t)
    return t


def predictive(room: np.ndarray, byte: np.ndarray, n: np.ndarray, t: np.ndarray, parent: np.ndarray, discount: float) -> np.ndarray:
    """P(byte | context) of each restaurant (the rows), given its parent's probabilities."""
    total, tables = (np.bincount(room, weights=x, minlength=len(parent))[:, None] for x in (n, t))
    p = (STRENGTH + discount * tables) / (STRENGTH + total) * parent
    p[room, byte] += (n - discount * t) / (STRENGTH + total[room, 0])
    return p


class Spelling:
    """The spelling restaurants' state between sweeps."""

    def __init__(self):
        self.uniform = np.full(256, 1 / 256)
        self.one = np.tile(self.uniform, (256, 1))
        self.logs = self._logs(np.zeros(0, np.int64), np.zeros((0, 256)))

    def _logs(self, contexts: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the contexts that occur; all others have that of their last byte."""
        rows = np.tile(np.arange(256, dtype=np.int32) + len(p), 256)
        rows[contexts] = np.arange(len(p))
        return rows, np.log10(np.concatenate([p, self.one])).astype(np.float32)  # the spelling model itself is single precision, on every path

    def sweep(self, customers: DataFrame, sweep: int) -> None:
        d0, d1, d2 = SPELLING_DISCOUNTS
        seated = _seat_contexts(customers, self.one.ravel(), d2, sweep).toArrow()  # 256 ** 3 rows at most
        cell, n, t = (seated[c].to_numpy() for c in ("cell", "n", "t"))
        upper = np.bincount(cell & 0xFFFF, weights=t, minlength=1 << 16)
        at1 = np.flatnonzero(upper)
        n1 = upper[at1].astype(np.int64)
        t1 = seat_restaurants(at1 >> 8, n1, self.uniform[at1 & 0xFF], d1, mixed(at1, 1, sweep))
        top = np.bincount(at1 & 0xFF, weights=t1, minlength=256)
        at0 = np.flatnonzero(top)
        n0 = top[at0].astype(np.int64)
        t0 = seat_restaurants(at0 >> 8, n0, self.uniform[at0], d0, mixed(at0, 0, sweep))
        none = predictive(at0 >> 8, at0, n0, t0, self.uniform[None], d0)
        self.one = predictive(at1 >> 8, at1 & 0xFF, n1, t1, np.repeat(none, 256, axis=0), d1)
        contexts, room = np.unique(cell >> 8, return_inverse=True)
        self.logs = self._logs(contexts, predictive(room, cell & 0xFF, n, t, self.one[contexts & 0xFF], d2))


class Classes:
    """Numbers of the common words; a token's class is the word's number or ``n``."""

    def __init__(self, common: list[bytes], seed: int = 0):
        self.number, self.n, self.seed = {w: i for i, w in enumerate(common)}, len(common), seed

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.get, words, repeat(self.n)), np.int64, len(words))

    def names(self, words: list[bytes]) -> np.ndarray:
        """A common word's number, and a hash of any other."""
        kind = self.of(words)
        return np.where(kind < self.n, kind, hashes_of(words, self.seed).view(np.int64))

    def is_common(self, column: str):
        return F.col(column).between(0, self.n - 1)


def named_words(every: DataFrame, common: list[bytes]) -> tuple[DataFrame, Classes]:
    """(word, id, c, common), and the classes with a seed under which all words' ids differ."""
    seed = 0
    while True:
        classes = Classes(common, seed)

        def run(batches: Iterator[pa.RecordBatch], classes: Classes = classes) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = b["word"].to_pylist()
                yield pa.RecordBatch.from_arrays([b["word"], pa.array(classes.names(own), pa.int64()), b["c"], pa.array(classes.of(own) < classes.n)], names=["word", "id", "c", "common"])

        words = materialize(every.mapInArrow(run, "word binary, id long, c long, common boolean"), "named")
        alone = words.groupBy("id").agg(F.count("*").alias("k"), F.bool_and("common").alias("common"))
        if alone.where((F.col("k") > 1) | (classes.is_common("id") & ~F.col("common"))).isEmpty():
            return words, classes
        discard(words)
        seed += 1


class Numbered:
    """Texts' tokens as numbers of their different words, the end before the first."""

    def __init__(self, texts: list[bytes]):
        numbers: dict[bytes, int] = {b"": 0}
        self.docs = [np.array([0, *[numbers.setdefault(w, len(numbers)) for w in tokens_of(text)]], np.int32) for text in texts]
        self.words = list(numbers)

    def pairs(self, flat: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, second word, times) of the different pairs."""
        keys = [d[:-1].astype(np.int64) * len(self.words) + d[1:] for d in flat]
        at, n = np.unique(np.concatenate(keys), return_counts=True)
        return at // len(self.words), at % len(self.words), n


def pair_counts(docs: DataFrame, classes: Classes) -> DataFrame:
    """(u, w, n): how often word w follows u in training documents (id, __text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches, 2048):
            texts = [text for doc_id, text in zip(b["id"].to_pylist(), texts_of(b), strict=True) if not held_out(doc_id)]
            if texts:
                found = Numbered(texts)
                names = classes.names(found.words)
                u, w, n = found.pairs(found.docs)
                yield pa.RecordBatch.from_arrays([pa.array(names[u]), pa.array(names[w]), pa.array(n.astype(np.int64))], names=["u", "w", "n"])

    return docs.mapInArrow(run, "u long, w long, n long").repartition(_buckets(docs), "u", "w").groupBy("u", "w").agg(F.sum("n").alias("n"))


def _buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _in_buckets(df: DataFrame, name: str, *by: str) -> DataFrame:
    """A table written sorted in buckets by these columns and read back: joins by them don't shuffle it."""
    spark, path, table = df.sparkSession, new_path(df.sparkSession, name), f"rastrum_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(_buckets(df), *by).sortBy(*by).option("path", path).option("compression", "zstd").saveAsTable(table)
    out = spark.table(table)
    out._written_at, out._called = path, table
    return out


def _drop(table: DataFrame) -> None:
    table.sparkSession.sql(f"DROP TABLE {table._called}")
    discard(table)


def discount_of(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


class ClassModel:
    """The classes' restaurants between sweeps; counts: (cell, n) of the common words' restaurants."""

    def __init__(self, counts: DataFrame, size: int):
        self.counts, self.size, self.parent = counts, size, np.full(size, 1 / size)
        self.discount = discount_of(*(x or 0 for x in counts.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()))

    def sweep(self, shared: np.ndarray, k: int) -> np.ndarray:
        """P(class | class before), a row for each class before; shared: customers of the shared class's restaurant."""
        size, discount, spark = self.size, self.discount, self.counts.sparkSession
        held = spark.sparkContext.broadcast(self.parent)  # COMMON + 1 numbers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _together(batches):
                cell, n = b["cell"].to_numpy().astype(np.int64), b["n"].to_numpy()
                t = seat_restaurants(cell // size, n, held.value[cell % size], discount, mixed(cell, 3, k))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(n), pa.array(t.astype(np.int64))], names=["cell", "n", "t"])

        own = spark.createDataFrame([((size - 1) * size + int(i), int(shared[i])) for i in np.flatnonzero(shared)], "cell int, n long")  # COMMON + 1 rows
        rows = self.counts.unionByName(own).repartition(F.floor(F.col("cell") / size)).mapInArrow(run, "cell int, n long, t long")
        seated = rows.toArrow()  # (COMMON + 1) ** 2 rows at most
        cell, n, t = (seated[c].to_numpy().astype(np.int64) for c in ("cell", "n", "t"))
        total, tables = (np.bincount(cell // size, weights=x, minlength=size) for x in (n, t))
        out = np.outer((STRENGTH + discount * tables) / (STRENGTH + total), self.parent)
        out.ravel()[cell] += (n - discount * t) / (STRENGTH + total[cell // size])
        below = np.bincount(cell % size, weights=t, minlength=size)
        at = np.flatnonzero(below)
        under, m = discount_of(int((below == 1).sum()), int((below == 2).sum())), below[at].astype(np.int64)
        top = seat_restaurants(np.zeros(len(at), np.int64), m, np.full(len(at), 1 / size), under, mixed(at, 4, k)) if len(at) else np.zeros(0)
        self.parent = np.full(size, (STRENGTH + under * top.sum()) / (STRENGTH + m.sum()) / size)
        self.parent[at] += (m - under * top) / (STRENGTH + m.sum())
        return out


def _seat_pairs(multi: DataFrame, level: DataFrame, classes: Classes, row: np.ndarray, discount: float, sweep: int) -> DataFrame:
    """(u, w, n, t) of pairs that occur more than once; level: (id, p, follows); row: the shared class's probabilities."""
    size, row = classes.n, row.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.array(row)
        for b in batches:
            u, w, n, p, follows = (b[c].to_numpy(zero_copy_only=False) for c in ("u", "w", "n", "p", "follows"))
            if len(u):
                rare = (w < 0) | (w >= size)
                parent = np.where(rare, 10.0**p, 1.0) * np.where((u < 0) | (u >= size), of[np.where(rare, size, w)], 1.0)
                keys = mixed(u.view(np.uint64) ^ mixed(w.view(np.uint64), 6), 5, sweep)
                t = seats(n, (STRENGTH + discount * follows) * parent, discount, keys)
                yield pa.RecordBatch.from_arrays([b["u"], b["w"], b["n"], pa.array(t.astype(np.int64))], names=["u", "w", "n", "t"])

    rows = multi.join(level.select(F.col("id").alias("w"), "p"), "w").join(level.select(F.col("id").alias("u"), "follows"), "u")
    return rows.select("u", "w", "n", "p", "follows").mapInArrow(run, "u long, w long, n long, t long")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """All rows of a task as one table, if there are any."""
    if held := [b for b in batches if len(b)]:
        yield pa.Table.from_batches(held)


class Model:
    """Totals, the classes and their probabilities, the averaged sweeps' spelling
    probabilities with the weight of a new word, (word, id, c, tables, common, own,
    follows) and (u, w, n) with the mean tables (u, w, t) of pairs that occur more than
    once.  own: the word's probability less that of being new; follows: the tables of
    what follows it; both and tables are means.  alone: N of the common words' own restaurants."""

    def __init__(self, words: DataFrame, n: int, v: int, sweeps: list[tuple[tuple, float]], classes: Classes, follow: np.ndarray, pairs: DataFrame, multi: DataFrame, discount: float, alone: np.ndarray):
        self.words, self.n, self.v, self.sweeps, self.classes, self.follow = words, n, v, sweeps, classes, follow
        self.pairs, self.multi, self.discount, self.alone = pairs, multi, discount, alone

    def log_probability(self):
        """A function of uncommon words and their own probabilities, for tasks; what it needs is broadcast."""
        held = self.words.sparkSession.sparkContext.broadcast([logs for logs, _ in self.sweeps])  # SAMPLES times what a sweep broadcasts
        backs = [back for _, back in self.sweeps]

        def of(words: list[bytes], own: np.ndarray) -> np.ndarray:
            # sums of logs, as a long word's spelling may be too small for a double
            parts = np.array([spelled(words, logs) + math.log10(back) for logs, back in zip(held.value, backs, strict=True)])
            most = parts.max(axis=0)
            new = most + np.log10(np.mean(10.0 ** (parts - most), axis=0))
            with np.errstate(divide="ignore"):
                old = np.log10(own)
            high = np.maximum(old, new)
            return high + np.log10(10.0 ** (old - high) + 10.0 ** (new - high))

        return of

    def back_off(self):
        """A function of classes u and w, the log10 probability of w as an uncommon word, and c and follows of u, for tasks:
        log10 P(w | u) without the pair's own customers, and the same times STRENGTH + N of u's restaurant (0 if it isn't asked)."""
        n, discount = self.classes.n, self.discount
        held = self.words.sparkSession.sparkContext.broadcast((np.log10(self.follow), self.alone))  # (COMMON + 1) ** 2 numbers

        def of(u: np.ndarray, w: np.ndarray, p: np.ndarray, c: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            follow, alone = held.value
            asked = (u == n) | (w == n)
            total = np.log10(STRENGTH + np.where(u == n, c, alone[u]))
            new = np.log10(STRENGTH + discount * follows)
            q = np.where(w == n, p, 0.0)
            shown = follow[u, w]
            # a common word's class is drawn first, from a restaurant that the pair's customers aren't in
            return shown + q + np.where(asked, new - total, 0.0), np.where(asked, new + q + np.where(u == n, shown, 0.0), 0.0)

        return of


def fit(docs: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES, most_common: int = COMMON, every: DataFrame | None = None) -> Model:
    """Learn from documents (id, __text); every: their written ``word_counts``, which are deleted."""
    every = materialize(word_counts(docs), "words") if every is None else every
    n, v = (x or 0 for x in every.agg(F.sum("c"), F.count("*")).first())
    common = [bytes(r["word"]) for r in every.orderBy(F.desc("c"), "word").limit(most_common).collect()]  # most_common rows
    words, classes = named_words(every, common)
    size, spelling = classes.n + 1, Spelling()
    pairs = _in_buckets(pair_counts(docs, classes), "pairs", "u", "w")
    first = classes.is_common("u")
    kind = F.when(classes.is_common("w"), F.col("w")).otherwise(classes.n)
    counts = materialize(pairs.where(first).groupBy((F.col("u") * size + kind).cast("int").alias("cell")).agg(F.sum("n").alias("n")), "classes")
    alone = np.zeros(size)  # how often an uncommon word follows a common one
    for r in counts.where(F.col("cell") % size == classes.n).collect():  # COMMON rows
        alone[r["cell"] // size] = r["n"]
    rest = pairs.where(~(first & classes.is_common("w")))
    discount = discount_of(*(x or 0 for x in rest.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()))
    once = rest.where("n = 1")
    ones = words.join(once.groupBy(F.col("w").alias("id")).agg(F.count("*").alias("as_w")), "id", "left")
    ones = materialize(ones.join(once.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("as_u")), "id", "left").fillna(0), "ones")
    multi = materialize(rest.where("n > 1"), "multi")
    seated, told, tables, row, back, below = multi.withColumn("t", F.lit(1).cast("long")), None, 0.0, None, 0.0, 0.5
    class_model, follow, kept, levels, written, sweeps = ClassModel(counts, size), np.zeros((size, size)), [], [], [], []
    for k in range(burn_in + samples + 1):
        if k:
            p = F.log10(F.greatest((F.col("n") - below * F.col("t")) / (STRENGTH + customers), F.lit(0.0)) + back * F.pow(F.lit(10.0), "s"))
            before, seated = seated, materialize(_seat_pairs(multi, told.withColumn("p", p), classes, row, discount, k), "seated")
            if 1 < k <= burn_in + 1:
                discard(before)
        as_w, as_u = (seated.groupBy(F.col(c).alias("id")).agg(F.sum("t").alias("t" + c)) for c in "wu")
        level = ones.join(as_w, "id", "left").join(as_u, "id", "left").fillna(0)
        level = level.select("word", "id", "c", "common", (F.col("as_w") + F.col("tw")).alias("n"), (F.col("as_u") + F.col("tu")).alias("follows"))
        if not k:
            rare = level.where(~F.col("common"))
            below = discount_of(*(x or 0 for x in rare.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()))
        before, told = told, materialize(_seat_words(level, spelling.logs, below, tables, k), "level")
        if before is not None and k <= burn_in + 1:
            discard(before)
        rare = told.where(~F.col("common"))
        tables, customers, left = (float(x or 0) for x in rare.agg(F.sum("t"), F.sum("n"), F.sum("follows")).first())
        back = (STRENGTH + below * tables) / (STRENGTH + customers)
        spelling.sweep(_spelling_customers(rare), k)
        shared = np.zeros(size)
        for r in told.where("common").select("id", "n").collect():  # COMMON rows
            shared[r["id"]] = r["n"]
        shared[classes.n] = left - shared.sum()  # tables of uncommon words' restaurants whose dish isn't common
        found = class_model.sweep(shared, k)
        row = found[classes.n]
        if k > burn_in:
            follow += found / samples
            sweeps.append((spelling.logs, back))
            kept.append(seated)
            written.append(told)
            levels.append(told.withColumn("own", F.when(F.col("common"), 0.0).otherwise((F.col("n") - below * F.col("t")) / (STRENGTH + customers))))
    mean, t = levels[0], kept[0]
    for x, y in zip(levels[1:], kept[1:], strict=True):
        mean, t = mean.unionByName(x), t.unionByName(y)
    mean = mean.groupBy("word", "id", "c", "common").agg(F.avg("t").alias("tables"), F.avg("own").alias("own"), F.avg("follows").alias("follows"))
    averaged = materialize(mean, "averaged")
    t = _in_buckets(t.repartition(_buckets(docs), "u", "w").groupBy("u", "w").agg(F.avg("t").alias("t")), "tables", "u", "w")
    discard(every, words, counts, ones, multi, *kept, *written)
    return Model(averaged, n, v, sweeps, classes, follow, pairs, t, discount, alone)


def score(docs: DataFrame, model: Model, most_words: int = MOST_WORDS) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score, train_tokens) of documents (id, __id, __tag, __text); the model's pairs are deleted."""
    of = (_score_by_broadcast if model.v <= most_words else _score_by_join)(model)
    parts = SLICES if model.n >= SLICED else 1
    found = [materialize(of(docs.where(F.pmod("__tag", F.lit(parts)) == i)), "scores") for i in range(parts)]
    for table in (model.pairs, model.multi):
        _drop(table)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.withColumn("train_tokens", F.lit(model.n).cast("long"))


def _add_pairs(rows: DataFrame, model: Model) -> DataFrame:
    """(__id, __tag, id, copies, sums of the scores) of rows (__id, __tag, u, w, z, times, head): to what
    the heads hold, what a pair's own customers add; z: log10 of what they are added to."""
    rows = rows.join(model.pairs, ["u", "w"], "left").join(model.multi, ["u", "w"], "left")
    own = F.col("n") - model.discount * F.coalesce("t", F.lit(1.0))
    gain = F.when(F.col("z") > -300, F.log1p(own * F.pow(F.lit(10.0), -F.col("z"))) / math.log(10)).otherwise(F.log10(own) - F.col("z"))
    sums = rows.groupBy("__id", "__tag").agg(F.max("head.id").alias("id"), F.count("head").alias("copies"), *(F.sum(f"head.{c}").alias(c) for c in _SCORED[1:]), F.sum(F.col("times") * gain).alias("gain"))
    return sums.withColumn("score", F.col("score") + F.coalesce("gain", F.lit(0.0))).drop("gain")


def _heads(*columns) -> pa.StructArray:
    """Struct column of id and sums, a row each."""
    return pa.StructArray.from_arrays(list(columns), fields=[pa.field(c, t) for c, t in zip(_SCORED, _TYPES, strict=True)])


def _piece_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.int64(60)) + PIECES // 2


def broadcast_by_hash(numbered: DataFrame, counts: type) -> list | None:
    """Broadcasts of the sorted rows (h, c, p and more numbers), one for each sixteenth of the hashes, or nothing if two hashes are equal.

    The driver holds one piece at a time, not the table."""
    rows = materialize(numbered, "numbers")
    pieces, more = [], numbered.columns[2:]
    for k in range(PIECES):
        lo = (k - PIECES // 2) << 60
        got = rows.where(F.col("h").between(lo, lo + (1 << 60) - 1)).toArrow()  # a sixteenth of most_words rows
        order = np.argsort(h := got["h"].to_numpy())
        h = h[order]
        if (h[1:] == h[:-1]).any():
            pieces = None
            break
        pieces.append(numbered.sparkSession.sparkContext.broadcast((h, got["c"].to_numpy()[order].astype(counts), *(got[c].to_numpy()[order] for c in more))))
    discard(rows)
    return pieces


def looked_up(asked: np.ndarray, pieces: list) -> tuple[np.ndarray, ...]:
    """Which hashes are known, and their counts and other numbers, 0 where they aren't."""
    known, found = np.zeros(len(asked), bool), [np.zeros(len(asked)) for _ in pieces[0].value[1:]]
    part = _piece_of(asked)
    for k in np.unique(part).tolist():
        h, *numbers = pieces[k].value
        if len(h):
            i = np.flatnonzero(part == k)
            at = np.minimum(np.searchsorted(h, asked[i]), len(h) - 1)
            i, at = i[hit := h[at] == asked[i]], at[hit]
            known[i] = True
            for x, y in zip(found, numbers, strict=True):
                x[i] = y[at]
    return known, *found


def _score_by_broadcast(model: Model) -> Callable[[DataFrame], DataFrame]:
    of, back_off = model.log_probability(), model.back_off()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                p = of(b["word"].to_pylist(), b["own"].to_numpy(zero_copy_only=False))
                p[b["common"].to_numpy(zero_copy_only=False)] = 0.0
                yield pa.RecordBatch.from_arrays([b["id"], b["c"], pa.array(p), b["follows"]], names=["h", "c", "p", "follows"])

    numbered = model.words.mapInArrow(number, "h long, c long, p double, follows double")
    pieces = broadcast_by_hash(numbered, np.uint32 if model.n < 1 << 32 else np.int64)  # all words' ids differ
    held = model.words.sparkSession.sparkContext.broadcast(model.classes)
    base = math.log10(model.n + model.v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = held.value
        for b in in_parts(batches, 1024):
            found = Numbered(texts_of(b))
            own, names, kind = found.words, classes.names(found.words), classes.of(found.words)
            known, c, p, follows = looked_up(names, pieces)
            new = np.flatnonzero(~known)
            p[new] = of([own[i] for i in new.tolist()], np.zeros(len(new)))
            plain = np.log10(c + 1) - base
            sizes = np.array([len(d) - 1 for d in found.docs])
            starts = np.cumsum(sizes) - sizes
            u, w = (np.concatenate([d[x] for d in found.docs]) for x in (slice(0, -1), slice(1, None)))
            q, z = back_off(kind[u], kind[w], p[w], c[u], follows[u])
            ids, tags = (b[x].to_numpy(zero_copy_only=False) for x in ("__id", "__tag"))
            sums = [np.add.reduceat(x, starts) for x in (known[w].astype(np.int64), plain[w], q)]
            heads = _heads(b["id"], pa.array(sizes, pa.int64()), *map(pa.array, sums))
            # heads go where their hashes say, and nothing is added to them
            yield _rows(ids, tags, tags, ids, np.zeros(len(ids)), np.zeros(len(ids), np.int64), heads)
            at = np.flatnonzero(known[u] & known[w] & ((kind[u] == classes.n) | (kind[w] == classes.n)))
            doc = np.repeat(np.arange(len(sizes)), sizes)[at]
            _, first, times = np.unique((doc * len(own) + u[at]) * len(own) + w[at], return_index=True, return_counts=True)
            at, doc = at[first], doc[first]
            for i in range(0, len(at), 100_000):
                x, d = at[i : i + 100_000], doc[i : i + 100_000]
                yield _rows(ids[d], tags[d], names[u[x]], names[w[x]], z[x], times[i : i + 100_000], _heads(*(pa.array([], t) for t in _TYPES)).take(pa.nulls(len(x), pa.int64())))

    def scored(docs: DataFrame) -> DataFrame:
        each = _add_pairs(docs.select("id", "__id", "__tag", "__text").mapInArrow(run, _ROWS), model)
        # repeated rows were summed up together
        shares = [(F.col(c) / F.col("copies")).cast("long" if c.startswith("n_") else "double").alias(c) for c in _SCORED[1:]]
        return each.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("id", *shares)

    return scored


_ROWS = "__id long, __tag long, u long, w long, z double, times long, head struct<id: long, n_tokens: long, n_known: long, base_score: double, score: double>"


def _rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=["__id", "__tag", "u", "w", "z", "times", "head"])


_SCORED = ["id", "n_tokens", "n_known", "base_score", "score"]
_TYPES = [pa.int64()] * 3 + [pa.float64()] * 2


def _score_by_join(model: Model) -> Callable[[DataFrame], DataFrame]:
    of, back_off = model.log_probability(), model.back_off()
    held = model.words.sparkSession.sparkContext.broadcast(model.classes)
    base = math.log10(model.n + model.v + 1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, tag, text in zip(b["__id"].to_pylist(), b["__tag"].to_pylist(), texts_of(b), strict=True):
                own = tokens_of(text)
                pairs = Counter(zip([b"", *own], own))
                u, w = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(pairs)), pa.array([tag] * len(pairs)), pa.array(u, pa.binary()), pa.array(w, pa.binary()), pa.array(list(pairs.values()), pa.int64())], names=["__id", "__tag", "u", "w", "times"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = held.value
        for b in batches:
            if len(b):
                u, w = b["u"].to_pylist(), b["w"].to_pylist()
                times, c, own, cu, follows = (b[x].to_numpy(zero_copy_only=False).astype(float) for x in ("times", "c", "own", "cu", "follows"))
                ku, kw = classes.of(u), classes.of(w)
                p = of(w, own)
                p[kw < classes.n] = 0.0
                q, z = back_off(ku, kw, p, cu, follows)
                n = times.astype(np.int64)
                heads = _heads(pa.nulls(len(b), pa.int64()), pa.array(n), pa.array(n * (c > 0)), pa.array(times * (np.log10(c + 1) - base)), pa.array(times * q))
                yield _rows(b["__id"], b["__tag"], classes.names(u), classes.names(w), z, n * ((ku == classes.n) | (kw == classes.n)), heads)

    def scored(docs: DataFrame) -> DataFrame:
        one = docs.dropDuplicates(["__id", "__tag"]).select("__id", "__tag", "__text")
        rows = one.mapInArrow(spread, "__id long, __tag long, u binary, w binary, times long")
        rows = rows.join(model.words.select(F.col("word").alias("w"), "c", "own"), "w", "left")
        rows = rows.join(model.words.select(F.col("word").alias("u"), F.col("c").alias("cu"), "follows"), "u", "left").fillna(0)
        each = _add_pairs(rows.select("__id", "__tag", "u", "w", "times", "c", "own", "cu", "follows").mapInArrow(weigh, _ROWS), model)
        return docs.select("id", "__id", "__tag").join(each.drop("id"), ["__id", "__tag"]).select(*_SCORED)

    return scored


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the job that wrote them ends, as all tables here are written before others read them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_words: int | None = None) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every document."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    own = with_row_key(own, "id", "__text")
    from rastrum.llm import lm_packed  # which builds on this module

    with _shuffles_removed(docs.sparkSession):
        every = materialize(word_counts(own), "words")
        if every.count() <= (lm_packed.MOST_WORDS if most_words is None else most_words):
            found = lm_packed.score(own, every)
            discard(every)
        else:
            found = score(own, fit(own, every=every), MOST_WORDS if most_words is None else most_words)
    aside = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    return found.select(
        F.col("id").alias(id_col), aside.alias("held_out"), "n_tokens", "n_known", F.col("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
