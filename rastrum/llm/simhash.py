"""SimHash near-duplicates by a generalised pigeonhole over bit partitions.

A fingerprint has 64 bits.  Bits that go together in the data are put in one
partition; dynamic programming hands each partition its own threshold, -1 to
leave it out, so that the thresholds add up to ``radius - partitions + 1``: two
fingerprints within the radius then agree on some partition within its
threshold.  Every fingerprint is filed under its own value of each partition and
probes the values within the partition's threshold; who meets under a value is
verified by exact distance, and these pairs are the links.

Copies of a text have one fingerprint and are one node.  A value under which more
than ``MOST`` fingerprints meet is not paired off: its fingerprints are put under
every value of all 64 bits that differs from theirs in at most one bit.  Two
within two bits of each other meet under such a value, at most 65 can, and all
are linked to the smallest of them, which keeps what is reachable from what.

Defined results: a null or empty text has no words and fingerprint zero, which
links like any other; null ids take part but are never the smallest id of a
group unless it has no other; repeated rows stay, ``dedup`` keeps one of them; an
empty table gives no rows; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrum.llm.common import connected_components, materialize, texts_of, unveiled, veiled, with_row_key

BITS = 64
SHINGLE = 3
SEED = 42
RADIUS = 2
#: More fingerprints than these under one value of a partition are linked by way of their neighbours.
MOST = 64
#: At most this many hashes are unpacked to bits at once.
BLOCK = 1 << 14


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A signed 64-bit integer; bit i is set if over half the shingle hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(whole, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: -shingle])).tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a:b], seed) for a, b in zip(starts, stops, strict=True)]
    return majority(np.array(hashes, dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """The fingerprint of unsigned 64-bit hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), BLOCK):
        part = h[at : at + BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, __id, __tag, __fp) of every row; __id and __tag are the row's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([fingerprint(t, shingle) for t in texts_of(b)], pa.int64())
            yield pa.RecordBatch.from_arrays([b["id"], b["__id"], b["__tag"], found], names=["id", "__id", "__tag", "__fp"])

    keyed = with_row_key(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("__text")), "id", "__text")
    return keyed.mapInArrow(run, "id long, __id long, __tag long, __fp long")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often bits i and j are set together, over all of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, n = np.zeros((BITS, BITS)), 0
        for pdf in batches:
            v = pdf["fp"].to_numpy(np.int64)
            bits = np.unpackbits(v.astype("<i8").view(np.uint8).reshape(len(v), 8), axis=1, bitorder="little").astype(np.float64)
            both += bits.T @ bits
            n += len(v)
        if n:
            i, j = np.triu_indices(BITS)
            yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "n": np.append(both[i, j], n).astype(np.int64)})

    rows = fps.select("fp").mapInPandas(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 2081 rows
    counts, total = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r["i"] < 0:
            total = r["n"]
        else:
            counts[r["i"], r["j"]] = counts[r["j"], r["i"]] = r["n"]
    return total, counts


def correlated_partitions(total: int, counts: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of about equal width, each grown by the bit most correlated with it."""
    p = np.diag(counts) / max(total, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs((counts / max(total, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        width = (len(left) + parts - k - 1) // (parts - k)
        group = [max(left, key=lambda b: (related[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < width:
            best = max(left, key=lambda b: (related[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def ball(width: int, radius: int) -> int:
    """Values within ``radius`` bits of a value of ``width`` bits."""
    total, term = 0, 1
    for k in range(radius + 1):
        total += term
        term = term * (width - k) // (k + 1)
    return total


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost that add up to ``budget``; costs[i][t + 1] is partition i's at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        grown: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, c in enumerate(row, -1):
                if (had := grown.get(spent + t)) is None or cost + c < had[0]:
                    grown[spent + t] = (cost + c, [*chosen, t])
        best = grown
    return best[budget]


def plan(fps: DataFrame, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed.

    For two to ``radius + 1`` partitions the pairs of fingerprints that share a
    value of a partition are counted over all of them; a larger threshold is taken
    to multiply them by the values in its ball.  A probe costs one, and
    so does a candidate pair; in a crowded value a fingerprint costs its neighbours.
    """
    total, counts = bit_counts(fps)
    layouts = {m: correlated_partitions(total, counts, m) for m in range(2, radius + 2)}
    masks = [(m, i, _signed(sum(1 << b for b in g))) for m, groups in layouts.items() for i, g in enumerate(groups)]
    values = fps.select(F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v")) for m, i, mask in masks))).alias("x")).select("x.*")
    meets = values.groupBy("m", "i", "v").count().where("count > 1").groupBy("m", "i").agg(F.sum(F.col("count") * F.least(F.col("count") - 1, F.lit(BITS + 1))).alias("n"))
    found = {(r["m"], r["i"]): r["n"] for r in meets.collect()}  # one row per partition
    best = None
    for m, groups in layouts.items():
        costs = [[0.0] + [total * ball(len(g), t) + found.get((m, i), 0) * ball(len(g), t) for t in range(radius + 1)] for i, g in enumerate(groups)]
        cost, chosen = allocate(costs, radius - m + 1)
        if best is None or cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0])
    return best[1]


def filed(fps: DataFrame, partitions: list[tuple[list[int], int]]) -> DataFrame:
    """(part, v, fp, own): every fingerprint under its own values, and under those that it probes."""
    keys = []
    for i, (bits, t) in enumerate(partitions):
        value = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))
        flips = {0}
        for _ in range(t):
            flips |= {f ^ (1 << b) for f in flips for b in bits}
        keys += [F.struct(F.lit(i).alias("part"), value.bitwiseXOR(F.lit(_signed(f))).alias("v"), F.lit(not f).alias("own")) for f in sorted(flips)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.part", "k.v", "fp", "k.own")


def links(fps: DataFrame, partitions: list[tuple[list[int], int]], radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(a, b): edges that connect exactly the fingerprints within the radius, of one or two bits, directly or by way of others."""
    if radius not in (1, 2):
        raise ValueError("neighbours in one bit connect fingerprints within one or two bits only")
    rows = filed(fps, partitions)
    # counted first: what is gathered below has a bound
    met = rows.groupBy("part", "v").agg(F.count("*").alias("n"), F.count_if("own").alias("owners")).where("owners > 0 and n > 1")
    met = materialize(met.select("part", "v", "n"), "met")
    small = rows.join(met.where(F.col("n") <= most).select("part", "v"), ["part", "v"])
    groups = small.groupBy("part", "v").agg(F.collect_list(F.when(F.col("own"), F.col("fp"))).alias("owners"), F.collect_list("fp").alias("all"))
    near = F.transform("owners", lambda x: F.transform(F.filter("all", lambda y: (x != y) & (F.bit_count(x.bitwiseXOR(y)) <= radius)), lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))))
    pairs = groups.select(F.explode(F.flatten(near)).alias("p")).select("p.a", "p.b")
    crowd = rows.join(met.where(F.col("n") > most).select("part", "v"), ["part", "v"]).select("fp").distinct()
    return pairs.unionByName(neighbour_links(crowd, radius)).distinct()


def neighbour_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): edges that connect exactly the fingerprints within one or two bits, by way of others or directly."""
    shifts = [0, *(_signed(1 << b) for b in range(BITS))]
    spread = fps.select("fp", F.explode(F.transform(F.array(*map(F.lit, shifts)), lambda s: F.col("fp").bitwiseXOR(s))).alias("near"))
    met = spread.groupBy("near").agg(F.array_sort(F.collect_set("fp")).alias("fps")).where("size(fps) > 1")  # 65 at most
    pairs = met.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, BITS + 1)).alias("b"))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, __id, __tag, __fp, __group, component) for every row: __group is the
    smallest fingerprint and component the smallest id reachable."""
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = materialize(rows.groupBy(F.col("__fp").alias("fp")).agg(F.min("id").alias("first")), "distinct")
    reach = connected_components(links(fps, plan(fps))).withColumnRenamed("node", "fp")
    groups = fps.join(reach, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("__group"))
    smallest = groups.groupBy("__group").agg(F.min("first").alias("component"))
    named = groups.join(smallest, "__group").select(F.col("fp").alias("__fp"), "__group", "component")
    return rows.join(named, "__fp").select("id", "__id", "__tag", "__fp", "__group", "component")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group: the smallest id, a null id last; of repeated rows, one."""
    return one_of_each(docs, near_groups(docs, id_col, text_col), id_col, text_col)


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents' rows, one of each ``__group`` of rows (id, __id, __tag, __group)."""
    first = F.min(F.struct(F.col("id").isNull(), F.col("__id"), F.col("__tag"))).alias("x")
    keep = groups.groupBy("__group").agg(first).select("x.__id", "x.__tag")
    own, names = veiled(docs)
    kept = with_row_key(own, names[id_col], names[text_col]).join(keep, ["__id", "__tag"])
    return unveiled(kept.dropDuplicates(["__id", "__tag"]), names)
