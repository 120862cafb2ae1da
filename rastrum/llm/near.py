"""Near copies by SimHash and exact similarity: word shingles of five words, Jaccard 0.8 or more.

Texts are linked if the sets of their shingles have that similarity, and what is
reachable is one group.  A text is the set of its distinct shingles, named by
64-bit hashes, and texts of equal sets are one node, named by a 64-bit hash of
the set; results are exact up to collisions of these names.

Nodes get SimHash fingerprints, and the generalised pigeonhole of ``simhash``
finds those that differ in at most two bits.  No number of bits bounds the
similarity: copies at 0.8 were seen to differ in up to eleven of 64.  So a second
search finds what is left: with the shingles of all texts in one order, two sets
of similarity s share a shingle among the first n - ceil(s n) + 1 of each.  The
order puts shingles in crowded cells of a count table last, so that common lines
and passages are seldom in such a prefix; the table has a fixed size, counts all
texts, and only moves work.  In a bucket (the nodes with a
shingle in their prefix) every node is first held against the one with the fewest
shingles before it; then all of a bucket that are still in different groups, and
that sizes and places do not rule out, are held against each other.

Pairs are verified twice: how many shingles fall in each of ``COUNTS`` cells
bounds what two sets share, and the pairs that this leaves are compared shingle
by shingle.

Defined results: a text of one to five words has one shingle, itself; null and
empty texts have none and are copies of each other; the smallest id of a group is
kept, a null id last, and of repeated rows one; an empty table gives no rows;
other columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrum.llm import simhash
from rastrum.llm.common import connected_components, discard, in_parts, materialize, texts_of, with_row_key

SHINGLE = 5
#: Similarity is at least NUM / DEN.
NUM, DEN = 4, 5
SEED = 42
#: Cells of the count table.
CELLS = 1 << 18
#: Postings are dealt by shingle in so many parts; a shingle goes by its upper 44 bits there, which only adds candidates.
PARTS = 1 << 12
POSTING = np.dtype([("g", "<i8"), ("node", "<i8"), ("at", "<i4"), ("n", "<i4")])
#: Cells that a set's shingles are counted in, and the largest count that is exact.
COUNTS, FULL = 512, 255
#: Size of the table that says which texts may be wanted.
BITS = 1 << 20


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes in ascending order."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    whole = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(whole, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-size])).tolist()
        stops = (ends[size - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a:b], SEED) for a, b in zip(starts, stops, strict=True)]
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def node_of(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes(), SEED)).view(np.int64))


def levels(keyed: DataFrame) -> np.ndarray:
    """How crowded each cell of shingles is: 0 for most, then by powers of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int64)
        for b in in_parts(batches):
            for text in texts_of(b):
                np.add.at(n, shingles(text) & (CELLS - 1), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["cell", "n"])

    got = keyed.select("__text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    n = np.zeros(CELLS)
    n[got["cell"].to_numpy()] = got["n"].to_numpy()
    usual = n.mean() + 4 * np.sqrt(n.mean())
    return np.log2(1 + np.maximum(n - usual, 0)).astype(np.int8)


def counts_of(own: np.ndarray) -> bytes:
    """How many shingles fall in each cell, ``FULL`` at most."""
    return np.minimum(np.bincount(own >> 40 & (COUNTS - 1), minlength=COUNTS), FULL).astype(np.uint8).tobytes()


def nodes(keyed: DataFrame) -> DataFrame:
    """(id, __id, __tag, node, fp, n, counts) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            own = list(map(shingles, texts_of(b)))
            found = [
                pa.array(list(map(node_of, own)), pa.int64()),
                pa.array([simhash.majority(s.astype("<u8")) for s in own], pa.int64()),
                pa.array(list(map(len, own)), pa.int32()),
                pa.array(list(map(counts_of, own)), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([b["id"], b["__id"], b["__tag"], *found], names=["id", "__id", "__tag", "node", "fp", "n", "counts"])

    return keyed.mapInArrow(run, "id long, __id long, __tag long, node long, fp long, n int, counts binary")


def postings(keyed: DataFrame, level: np.ndarray) -> DataFrame:
    """(part, found): the shingles of every text's prefix with their text's node, their places and the set's size, packed by part."""
    held = keyed.sparkSession.sparkContext.broadcast(level)  # CELLS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches, 4096):
            all_ = []
            for text in texts_of(b):
                own = shingles(text)
                if size := len(own):
                    first = size - (NUM * size + DEN - 1) // DEN + 1
                    one = np.empty(first, POSTING)
                    one["g"] = own[np.argsort(held.value[own & (CELLS - 1)], kind="stable")[:first]] >> 20
                    one["node"], one["at"], one["n"] = node_of(own), np.arange(first), size
                    all_.append(one)
            if all_:
                flat = np.concatenate(all_)
                flat = flat[np.argsort(flat["g"] % PARTS, kind="stable")]
                part, starts = np.unique(flat["g"] % PARTS, return_index=True)
                found = pa.array([x.tobytes() for x in np.split(flat, starts[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), found], names=["part", "found"])

    return keyed.select("__text").mapInArrow(run, "part int, found binary")


def shared_postings(packed: DataFrame) -> DataFrame:
    """(g, node, at, n) of the shingles that more than one node has in its prefix, each node once."""

    def run(table: pa.Table) -> pa.Table:
        own = np.frombuffer(b"".join(table["found"].to_pylist()), POSTING)
        own = own[np.lexsort((own["at"], own["node"], own["g"]))]
        same = own["g"][1:] == own["g"][:-1]
        new = np.append(True, ~same | (own["node"][1:] != own["node"][:-1]))
        own = own[new]
        _, at, times = np.unique(own["g"], return_inverse=True, return_counts=True)
        own = own[times[at] > 1]
        return pa.table([pa.array(np.ascontiguousarray(own[c])) for c in POSTING.names], names=POSTING.names)

    return packed.groupBy("part").applyInArrow(run, "g long, node long, at int, n int")


def sets(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, s): the shingles of the rows (node, __id, __tag), texts that can't be wanted left out before they are dealt."""
    bit = F.pmod(F.xxhash64("__id", "__tag"), F.lit(BITS)).cast("int").alias("bit")
    got = wanted.select(bit).distinct().toArrow()["bit"].to_numpy()  # BITS rows at most
    some = np.zeros(BITS, bool)
    some[got] = True
    held = keyed.sparkSession.sparkContext.broadcast(np.packbits(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = np.unpackbits(held.value).astype(bool)
        for b in in_parts(batches):
            b = b.filter(pa.array(hit[b["bit"].to_numpy()]))
            found = pa.array([shingles(t) for t in texts_of(b)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b["__id"], b["__tag"], found], names=["__id", "__tag", "s"])

    found = keyed.select("__id", "__tag", bit, "__text").mapInArrow(run, "__id long, __tag long, s array<long>")
    return found.join(wanted, ["__id", "__tag"]).dropDuplicates(["__id", "__tag"]).select("node", "s")


def _possible() -> F.Column:
    """What sizes and places leave open; the shingles before a shared one are shared at most up to the lesser place.

    The pair's first shared shingle is met too, and there no shingle before it is shared, so no pair is lost."""
    most = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    return (NUM + DEN) * most >= NUM * (F.col("x.n") + F.col("y.n"))


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _may_be(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose counts leave the similarity open; where both counts of a cell are full the lesser set's size bounds it."""
    for b in batches:
        if len(b):
            x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint8).reshape(-1, COUNTS) for c in ("ca", "cb"))
            least = np.minimum(x, y)
            n, m = (b[c].to_numpy().astype(np.int64) for c in ("na", "nb"))
            most = np.minimum(np.where((least == FULL).any(axis=1), np.inf, least.sum(axis=1, dtype=np.int64)), np.minimum(n, m))
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array((NUM + DEN) * most >= NUM * (n + m)))


def similar(pairs: DataFrame, keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()

    one = rows.join(ends(pairs), "node").groupBy("node").agg(F.first("n").alias("n"), F.first("counts").alias("c"))
    both = pairs.join(one.toDF("a", "na", "ca"), "a").join(one.toDF("b", "nb", "cb"), "b")
    pairs = materialize(both.mapInArrow(_may_be, "a long, b long"), "open")
    wanted = materialize(rows.join(ends(pairs), "node").groupBy("node").agg(F.min(F.struct("__id", "__tag")).alias("k")).select("node", "k.*"), "wanted")
    held = materialize(sets(keyed, wanted), "sets")
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(held.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    found = materialize(both.where((NUM + DEN) * F.size(F.array_intersect("sa", "sb")) >= NUM * (F.size("sa") + F.size("sb"))).select("a", "b"), "links")
    discard(pairs, wanted, held)
    return found


def simhash_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): nodes whose fingerprints are linked; nodes of one fingerprint are held against the smallest."""
    one = materialize(rows.where("n > 0").groupBy("node").agg(F.first("fp").alias("fp")), "fps")
    leads = one.groupBy("fp").agg(F.min("node").alias("lead"))
    near = simhash.links(leads.select("fp"), simhash.plan(leads.select("fp")))
    far = near.join(leads.select(F.col("fp").alias("a"), F.col("lead").alias("x")), "a").join(leads.select(F.col("fp").alias("b"), F.col("lead").alias("y")), "b")
    same = one.join(leads, "fp").where("node <> lead").select(F.col("lead").alias("x"), F.col("node").alias("y"))
    return far.select("x", "y").unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def links(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): edges that connect exactly the nodes of similar sets, directly or by way of others."""
    packed = materialize(postings(keyed, levels(keyed)), "postings")
    shared = materialize(shared_postings(packed), "shared")
    discard(packed)
    leaders = shared.groupBy("g").agg(F.min(F.struct("at", F.xxhash64("node").alias("h"), "node", "n")).alias("k")).select("g", "k.*")
    star = shared.alias("x").join(leaders.alias("y"), "g").where(F.col("x.node") != F.col("y.node")).where(_possible())
    tried = materialize(_pairs(star).unionByName(simhash_pairs(rows)).distinct(), "tried")
    first = similar(tried, keyed, rows)
    grouped = shared.join(connected_components(first), "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    split = grouped.groupBy("g").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("g")
    open_ = materialize(grouped.join(split, "g"), "open")
    rest = open_.alias("x").join(open_.alias("y"), "g").where((F.col("x.node") < F.col("y.node")) & (F.col("x.c") != F.col("y.c"))).where(_possible())
    left = materialize(_pairs(rest).join(tried, ["a", "b"], "left_anti"), "rest")
    more = similar(left, keyed, rows)
    discard(open_, left, tried, shared)
    return first.unionByName(more)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, __id, __tag, node, __group) for every row; rows of a group share __group."""
    keyed = with_row_key(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("__text")), "id", "__text")
    rows = materialize(nodes(keyed), "nodes")
    reach = connected_components(links(keyed, rows))
    return rows.join(reach, "node", "left").select("id", "__id", "__tag", "node", F.coalesce("component", "node").alias("__group"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group: the smallest id, a null id last; of repeated rows, one."""
    return simhash.one_of_each(docs, near_groups(docs, id_col, text_col), id_col, text_col)
