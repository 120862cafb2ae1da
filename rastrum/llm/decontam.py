"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

A benchmark item's windows are its runs of ``n`` words, or the whole item if it
has fewer.  While the hash set that is built of them stays under ``MOST_BYTES`` it
is broadcast; a document is turned into word numbers, and only places where a
whole window's words all occur in the benchmark are looked up, by their exact
numbers.  A larger benchmark is joined on the windows instead, those of a
document first held against a broadcast table of ``BITS`` bits.

Defined results: null or empty texts have no words and are never hit; an item
without words has no window; an item without an id marks words but is not
named; repeated rows and items with one id count as they stand; an empty table
on either side gives no hits; other columns are left alone, one called like a new
column gets ``_in`` appended.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastrum.llm.common import in_parts, materialize, texts_of, unveiled, veiled, with_row_key

N = 10
#: A hash set of more bytes, as a worker holds it, is joined, not broadcast.
MOST_BYTES = 64 << 20
#: What a window and a word take there at most, without the word's own bytes.
WINDOW_BYTES, WORD_BYTES = 600, 200
BITS = 1 << 23

_WORD = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLD = bytes(c if c in _WORD else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_FIND = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


hash_of = xxhash.xxh64_intdigest


def windows_of(words: list, n: int) -> Iterator[list]:
    if 0 < len(words) < n:
        yield words
    for i in range(len(words) - n + 1):
        yield words[i : i + n]


class WindowSet:
    """Windows of the benchmark by length; words are numbered from 1."""

    def __init__(self, numbers: dict[bytes, int], windows: dict[int, dict[bytes, set[str]]]):
        self.numbers, self.windows = numbers, windows

    def add(self, items: list[tuple[str | None, bytes]], n: int) -> "WindowSet":
        for name, text in items:
            for window in windows_of(words_of(text), n):
                key = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in window], np.int32)
                named = self.windows.setdefault(len(window), {}).setdefault(key.tobytes(), set())
                if name is not None:
                    named.add(name)
        return self

    def hits(self, text: bytes) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, which of them are hit, and the items with occurring windows."""
        words = words_of(text)
        numbers = np.fromiter(map(self.numbers.get, words, repeat(0)), np.int32, len(words))
        edge = np.zeros(len(words) + 1, np.int64)
        unknown = np.concatenate(([0], np.cumsum(numbers == 0)))
        items: set[str] = set()
        for n, windows in self.windows.items():
            for i in np.flatnonzero(unknown[n:] == unknown[:-n]) if len(words) >= n else ():
                if (named := windows.get(numbers[i : i + n].tobytes())) is not None:
                    items |= named
                    edge[i] += 1
                    edge[i + n] -= 1
        return len(words), np.cumsum(edge[:-1]) > 0, items


def built_size(items: DataFrame, n: int) -> int:
    """A bound on the bytes of the hash set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [(len(words), sum(map(len, words))) for words in map(words_of, texts_of(b))]
            yield pa.RecordBatch.from_arrays([pa.array([max(k - n + 1, k > 0) * WINDOW_BYTES + k * WORD_BYTES + size for k, size in sizes], pa.int64())], names=["bytes"])

    return items.mapInArrow(run, "bytes long").agg(F.sum("bytes")).first()[0] or 0


def bits_of(words: list[bytes], k: int) -> np.ndarray:
    """A bit's number for each run of ``k`` words."""
    h = np.fromiter((hash_of(w) for w in words), np.uint64, len(words))
    if len(h) < k:
        return np.zeros(0, np.int64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
    return (out >> np.uint64(40)).astype(np.int64) & (BITS - 1)


def _by_broadcast(keyed: DataFrame, items: DataFrame, n: int) -> DataFrame:
    spark = keyed.sparkSession
    built = WindowSet({}, {}).add([(r[0], r[1].encode()) for r in items.collect()], n)  # at most MOST_BYTES
    held = spark.sparkContext.broadcast((built.numbers, built.windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = WindowSet(*held.value)
        for b in in_parts(batches):
            counts, hit, named = [], [], []
            for t in texts_of(b):
                n_words, marks, found = windows.hits(t)
                counts.append(n_words)
                hit.append(np.flatnonzero(marks).tolist())
                named.append(sorted(found))
            new = [pa.array(counts, pa.int64()), pa.array(hit, pa.list_(pa.int32())), pa.array(named, pa.list_(pa.string()))]
            b = b.drop_columns(["__text"])  # the table's own column goes on, not this copy
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "__n_words", "__hit", "__items"])

    return keyed.mapInArrow(run, T.StructType([*keyed.drop("__text").schema.fields, *_HITS]))


_HITS = (T.StructField("__n_words", T.LongType()), T.StructField("__hit", T.ArrayType(T.IntegerType())), T.StructField("__items", T.ArrayType(T.StringType())))


def _by_join(keyed: DataFrame, items: DataFrame, n: int) -> DataFrame:
    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(b" ".join(w), len(w), name) for name, t in zip(b["name"].to_pylist(), texts_of(b), strict=True) for w in windows_of(words_of(t), n)]
            yield pa.RecordBatch.from_pylist([{"w": w, "len": k, "name": name} for w, k, name in rows], pa.schema([("w", pa.binary()), ("len", pa.int32()), ("name", pa.string())]))

    wanted = materialize(items.mapInArrow(item_windows, "w binary, len int, name string").distinct(), "windows")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(bits_of(w.split(b" "), k)[0]) for w, k in zip(b["w"].to_pylist(), b["len"].to_pylist(), strict=True)], pa.int32())], names=["bit"])

    some = np.zeros(BITS, bool)
    some[wanted.select("w", "len").mapInArrow(numbered, "bit int").distinct().toArrow()["bit"].to_numpy()] = True  # BITS numbers at most
    held = keyed.sparkSession.sparkContext.broadcast(np.packbits(some))
    lengths = sorted(r[0] for r in wanted.select("len").distinct().collect())  # n values at most

    def doc_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = np.unpackbits(held.value).astype(bool)
        for b in batches:
            for i, t in enumerate(texts_of(b)):
                words = words_of(t)
                rows = [{"__id": b["__id"][i].as_py(), "__tag": b["__tag"][i].as_py(), "w": b" ".join(words[s : s + k]), "s": s, "len": k} for k in lengths for s in np.flatnonzero(some[bits_of(words, k)]).tolist()]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("__id", pa.int64()), ("__tag", pa.int64()), ("w", pa.binary()), ("s", pa.int32()), ("len", pa.int32())]))

    places = keyed.dropDuplicates(["__id", "__tag"]).select("__id", "__tag", "__text").mapInArrow(doc_windows, "__id long, __tag long, w binary, s int, len int")
    met = places.join(wanted.withColumnRenamed("len", "l"), "w")
    found = met.groupBy("__id", "__tag").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("s", F.col("s") + F.col("len") - 1))))).alias("__hit"),
        F.array_sort(F.collect_set("name")).alias("__items"),
    )
    none = "cast(array() as array<{}>)"
    counted = keyed.mapInArrow(_count, T.StructType([*keyed.schema.fields, T.StructField("__n_words", T.LongType())]))
    joined = counted.join(found, ["__id", "__tag"], "left")
    return joined.withColumns({"__hit": F.coalesce("__hit", F.expr(none.format("int"))), "__items": F.coalesce("__items", F.expr(none.format("string")))})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.append_column("__n_words", pa.array([len(words_of(t)) for t in texts_of(b)], pa.int64()))


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = N, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The documents' rows with n_words, hit (numbers of hit words) and items."""
    own, names = veiled(docs)
    found = _scan(own.withColumn("__text", F.coalesce(F.col(names[text_col]).cast("string"), F.lit(""))), names[id_col], benchmark, item_col, item_text_col, n, most_bytes)
    return unveiled(found, names, F.col("__n_words").alias("n_words"), F.col("__hit").alias("hit"), F.col("__items").alias("items"))


def _scan(docs: DataFrame, id_col: str, benchmark: DataFrame, item_col: str, item_text_col: str, n: int, most_bytes: int) -> DataFrame:
    items = benchmark.select(F.col(item_col).cast("string").alias("name"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("__text"))
    keyed = with_row_key(docs, id_col, "__text")
    return (_by_broadcast if built_size(items, n) <= most_bytes else _by_join)(keyed, items, n)


def remove_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents without those that are hit at all."""
    own, names = veiled(docs)
    return unveiled(scan(own, benchmark, names[id_col], names[text_col], **how).where(F.size("hit") == 0), names)


def cut_spans(text: bytes, hit: list[int]) -> bytes:
    """The text without the hit words; each run of them goes with what stands between its words."""
    marks, out, at, last = set(hit), [], 0, -2
    for i, m in enumerate(_FIND.finditer(text)):
        if i in marks:
            if last != i - 1:
                out.append(text[at : m.start()])
            at, last = m.end(), i
    return b"".join([*out, text[at:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents with the hit words cut out of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [cut_spans(t, h).decode("utf-8") for t, h in zip(texts_of(b), b["hit"].to_pylist(), strict=True)]
            yield b.set_column(b.schema.names.index("__text"), "__text", pa.array(cut, pa.string()))

    own, names = veiled(docs)
    found = scan(own, benchmark, names[id_col], names[text_col], **how).withColumn("__text", F.coalesce(F.col(names[text_col]).cast("string"), F.lit("")))
    cut = found.mapInArrow(run, found.schema)
    text = names[text_col]
    return unveiled(cut.withColumn(text, F.when(F.size("hit") > 0, F.col("__text")).otherwise(F.col(text))), names)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return scanned.select(
        id_col,
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )
