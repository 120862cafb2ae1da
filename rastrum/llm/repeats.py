"""Suffix-array dedup: long repeated byte strings, by distributed prefix doubling.

A string of ``length`` bytes is judged by its start.  Starts are not ranked one
by one from single bytes on, as most would stay alone after the first round and
the rest come in runs: all starts whose string holds the same rarest ``ANCHOR``
bytes (the window's smallest name) form a run around that anchor, and equal
strings have equal anchors in equal places.  So the first rank is the anchor's.
A run has a pair of ranks: one of the part that all its strings share, one of
all bytes that they cover.  Spark groups the pairs: a run whose shared part is
alone is unique; a run that occurs twice in full is settled as repeated; all
others are cut into smaller runs, whose shared parts are longer, and ranked
again, until they are unique, settled, or past the threshold, where a run is one
string of ``length`` bytes.  Ranks are names of 64 bits, so no round needs the
whole order; of strings that are compared, the anchors' names are equal too.

``method="doubling"`` is the plain form: Spark sorts the pairs of ranks of all
starts at offsets that double and ranks them anew, starts that are alone left out
before each round.  It compares bytes, not names, so it is exact, and it shuffles
some forty bytes for each byte of text; the default holds runs instead.

Defined results: a null text is empty; texts shorter than ``length`` are never
touched; null ids take part; repeated rows are copies of each other; an empty
table gives no rows; other columns are left alone, one called like a new column
gets ``_in`` appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastrum.llm.common import discard, materialize, per_worker, texts_of, unveiled, veiled, with_row_key

LENGTH = 400
ANCHOR = 100
#: Bytes of the prefixes that doubling ranks first: three numbers of eight.
FIRST = 24
#: Starts in a run at each round after the first.
STEPS = (32, 4, 1)
#: Bytes of a text that are named at once.
BLOCK = 1 << 22
_LOW = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte; powers of an odd base and of its inverse."""

    def make():
        numbers = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        powers = [np.cumprod(np.append(np.ones(1, np.uint64), np.full(size, base, np.uint64))) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
        return numbers, *powers

    size = 1 << max(12, int(n).bit_length())
    return per_worker(("repeats", size), make)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Names:
    """Names of a text's substrings: polynomials modulo 2 ** 64, mixed."""

    def __init__(self, text: bytes):
        numbers, self.up, self.down = _tables(len(text) + 1)
        self.sums = np.append(np.zeros(1, np.uint64), np.cumsum(numbers[np.frombuffer(text, np.uint8)] * self.up[: len(text)]))

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mix((self.sums[stops] - self.sums[starts]) * self.down[starts] + (stops - starts).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n] + np.uint64(width))


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` values in a row."""
    n = len(values)
    held = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    held[:n] = values
    rows = held.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(text: bytes, length: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor's name, name of all bytes, first start, last start, anchor's place) of each run."""
    for at in range(0, len(text) - length + 1, BLOCK):
        part = text[at : at + BLOCK + length - 1]
        names = Names(part)
        own = names.every(anchor)
        place = (smallest((own & ~_LOW) | np.arange(len(own), dtype=np.uint64), length - anchor + 1) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        last = np.append(first[1:], len(place)) - 1
        place = place[first]
        full = mix(names.of(first, last + length) + ((place - first) << 32).astype(np.uint64))
        yield own[place].view(np.int64), full.view(np.int64), first + at, last + at, place + at


_RUN = "name long, cell int, core long, full long, __id long, __tag long, at long, lo long, hi long, done boolean"
_RUN_NAMES = ["name", "cell", "core", "full", "__id", "__tag", "at", "lo", "hi", "done"]


def _settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ranked runs: those that are repeated in full, and those to rank again,
    with one of each settled run that they may meet."""
    pair, shared = ["name", "cell", "core", "full"], ["name", "cell", "core"]
    place = F.struct("__id", "__tag", "at", "lo", "hi")
    full = rows.groupBy(*pair).agg(F.count("*").alias("n"), F.max("done").alias("was"), F.min(place).alias("x"))
    full = materialize(full.withColumn("done", F.col("was") | (F.col("n") > 1)), "ranks")
    some = full.groupBy(*shared).agg(F.sum("n").alias("of"), F.count("*").alias("kinds"), F.min("done").alias("all")).where("of > 1 and kinds > 1 and not all").select(*shared)
    again = full.join(some, shared).select("name", "x.*", "done")
    repeated = rows.where("not done").join(full.where("n > 1").select(*pair), pair).select("__id", "__tag", "lo", "hi")
    return repeated, again


def _gathered(runs_: DataFrame, *by: str) -> DataFrame:
    return runs_.groupBy(*by).agg(F.collect_set(F.struct(*(c for c in runs_.columns if c not in by))).alias("__runs"))


def covered(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """(__id, __tag, __runs) of documents (__id, __tag, __text) with repeated
    strings: the first and last start of runs of them."""
    reach = length - anchor

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, tag, text in zip(b["__id"].to_pylist(), b["__tag"].to_pylist(), texts_of(b), strict=True):
                for name, full, lo, hi, place in runs(text, length, anchor):
                    n, zero = len(name), np.zeros(len(name), np.int64)
                    columns = [name, zero.astype(np.int32), zero, full, np.full(n, key), np.full(n, tag), place, lo, hi, zero > 0]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_RUN_NAMES)

    ranked = materialize(docs.select("__id", "__tag", "__text").mapInArrow(rank, _RUN), "runs")
    repeated, again = _settle(ranked)
    found = [materialize(repeated, "repeated")]

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, tag, text, held in zip(b["__id"].to_pylist(), b["__tag"].to_pylist(), texts_of(b), b["__runs"].to_pylist(), strict=True):
                anchors: dict[int, dict] = {}
                for r in held:
                    start = max(0, r["at"] - reach)
                    row = {"__id": key, "__tag": tag, "at": r["at"], "name": r["name"], "start": start, "piece": text[start : r["at"] + length], "__runs": []}
                    anchors.setdefault(r["at"], row)["__runs"].append({k: r[k] for k in ("lo", "hi", "done")})
                rows += anchors.values()
            yield pa.RecordBatch.from_pylist(rows, _PIECES)

    # the bytes around each anchor that is left, for the rounds to come
    around = docs.select("__id", "__tag", "__text").join(_gathered(again, "__id", "__tag"), ["__id", "__tag"])
    todo = pieces = materialize(around.mapInArrow(cut_out, "__id long, __tag long, at long, name long, start long, piece binary, __runs array<struct<lo:long,hi:long,done:boolean>>"), "pieces")
    for k, step in enumerate(steps):

        def rank_again(batches: Iterator[pa.RecordBatch], step: int = step) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = [[] for _ in _RUN_NAMES]
                for key, tag, at, name, start, piece, held in zip(*(b[c].to_pylist() for c in ("__id", "__tag", "at", "name", "start", "piece", "__runs")), strict=True):
                    names = Names(piece)
                    for r in held:
                        cells = np.arange((at - r["hi"]) // step, (at - r["lo"]) // step + 1)
                        lo, hi = np.maximum(at - cells * step - step + 1, r["lo"]), np.minimum(at - cells * step, r["hi"])
                        # what all strings of a whole cell share, so that cells cut short at a run's end can be compared
                        left, right = at - cells * step, at - np.minimum(cells * step + step - 1, reach) + length
                        core = names.of(left - start, right - start)
                        full = mix(names.of(lo - start, hi + length - start) + ((at - lo) << 32).astype(np.uint64) + (hi - lo).astype(np.uint64))
                        n = len(cells)
                        for to, x in zip(made, [np.full(n, name), cells.astype(np.int32), core.view(np.int64), full.view(np.int64), np.full(n, key), np.full(n, tag), np.full(n, at), lo, hi, np.full(n, r["done"])], strict=True):
                            to.append(x)
                if made[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in made], names=_RUN_NAMES)

        ranked = materialize(todo.mapInArrow(rank_again, _RUN), "runs")
        repeated, again = _settle(ranked)
        found.append(materialize(repeated, "repeated"))
        if k + 1 < len(steps):
            left = _gathered(again.select("__id", "__tag", "at", "name", "lo", "hi", "done"), "__id", "__tag", "at", "name")
            todo = pieces.drop("__runs").join(left, ["__id", "__tag", "at", "name"])
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return _gathered(every, "__id", "__tag")


_START = "d long, at int, times long, k0 long, k1 long, k2 long"


def _ranked(rows: DataFrame, *keys: str) -> DataFrame:
    """(d, at, times, rank) of the starts whose keys others have too; ranks are in the keys' order."""
    more = rows.groupBy(*keys).agg(F.sum("times").alias("n")).where("n > 1").select(*keys)
    order = materialize(more.orderBy(*keys).withColumn("new", F.monotonically_increasing_id()), "order")
    ranks = materialize(rows.join(order, [*keys]).select("d", "at", "times", F.col("new").alias("rank")), "ranks")
    discard(order)
    return ranks


def covered_by_doubling(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """What ``covered`` returns, by ranks of ever longer prefixes of all starts; ``length`` is ``FIRST`` at least.

    Repeated rows are ranked once and counted as often as they occur."""
    once = docs.groupBy("__id", "__tag").agg(F.first("__text").alias("__text"), F.count("*").alias("times"))
    once = materialize(once.withColumn("d", F.monotonically_increasing_id()), "texts")

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, times, text in zip(b["d"].to_pylist(), b["times"].to_pylist(), texts_of(b), strict=True):
                if len(text) < length:
                    continue
                for at in range(0, len(text) - FIRST + 1, BLOCK):
                    own = np.frombuffer(text[at : at + BLOCK + FIRST - 1], np.uint8).astype(np.uint64)
                    eight = np.zeros(len(own) - 7, np.uint64)
                    for i in range(8):
                        eight = eight << np.uint64(8) | own[i : i + len(eight)]
                    n = len(own) - FIRST + 1
                    keys = [pa.array(eight[i : i + n].view(np.int64)) for i in (0, 8, 16)]
                    place = pa.array(np.arange(at, at + n, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d)), place, pa.array(np.full(n, times)), *keys], names=["d", "at", "times", "k0", "k1", "k2"])

    every = materialize(once.select("d", "times", "__text").mapInArrow(starts, _START), "starts")
    ranks, width = _ranked(every, "k0", "k1", "k2"), FIRST
    discard(every)
    while width < length:
        step = min(width, length - width)
        ahead = ranks.select("d", (F.col("at") - step).cast("int").alias("at"), F.col("rank").alias("next"))
        pairs = materialize(ranks.join(ahead, ["d", "at"]), "pairs")
        before, ranks, width = ranks, _ranked(pairs, "rank", "next"), width + step
        discard(before, pairs)
    in_a_row = F.col("at") - F.row_number().over(Window.partitionBy("d").orderBy("at"))
    found = ranks.withColumn("run", in_a_row).groupBy("d", "run").agg(F.min("at").cast("long").alias("lo"), F.max("at").cast("long").alias("hi"))
    return _gathered(found.join(once.select("d", "__id", "__tag"), "d").select("__id", "__tag", "lo", "hi"), "__id", "__tag")


_PIECES = pa.schema(
    [(c, pa.int64()) for c in ("__id", "__tag", "at", "name", "start")]
    + [("piece", pa.binary()), ("__runs", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("done", pa.bool_())])))]
)


def spans_of(held: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal covered runs of bytes from runs of starts."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((r["lo"], r["hi"] + length) for r in held):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for lo, hi in spans:
        out.append(text[at:lo])
        at = hi
    return b"".join([*out, text[at:]])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, method: str = "anchors", **how) -> DataFrame:
    """The documents' rows with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept``
    (the bytes that stay; a character may be cut) and ``kept_sha256``.

    ``method`` is "anchors" or "doubling"; the rows are the same."""
    docs, names = veiled(docs)
    keyed = with_row_key(docs.withColumn("__text", F.coalesce(F.col(names[text_col]).cast("string"), F.lit(""))), names[id_col], "__text")
    both = keyed.join({"anchors": covered, "doubling": covered_by_doubling}[method](keyed, length, **how), ["__id", "__tag"], "left").select(*docs.columns, "__text", "__runs")
    own = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b)
            spans = [spans_of(held or [], length) for held in b["__runs"].to_pylist()]
            kept = [_without(t, s) for t, s in zip(texts, spans, strict=True)]
            new = [
                pa.array(list(map(len, texts)), pa.int64()),
                pa.array([sum(z - a for a, z in s) for s in spans], pa.int64()),
                pa.array(list(map(len, spans)), pa.int64()),
                pa.array(kept, pa.binary()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in own), *new], names=[*own, *_ADDED_NAMES])

    return unveiled(both.mapInArrow(run, T.StructType([*docs.schema.fields, *_ADDED.fields])), names, *map(F.col, _ADDED_NAMES))


_ADDED_NAMES = ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
_ADDED = T.StructType([T.StructField(c, t) for c, t in zip(_ADDED_NAMES, (T.LongType(), T.LongType(), T.LongType(), T.BinaryType(), T.StringType()), strict=True)])
