"""Shared folder, materialised tables, row keys and connected components."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, or
    what ``setCheckpointDir`` was given.

    Only a session on this machine alone gets a folder of its own if it names
    none; on a cluster that is refused, as other executors couldn't read it.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if not named and (given := context._jsc.sc().getCheckpointDir()).isDefined():
        named = given.get()
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = context.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="rastrum-")
    return _OWN_DIR[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rastrum-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there,
    so a lost executor costs the tasks at hand and not what came before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for tables that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def veiled(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with its columns called ``__c0``, ``__c1``, ..., and each one's name there.

    No name of the table's can then clash with one that an operator uses."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def unveiled(df: DataFrame, names: dict[str, str], *new: Column) -> DataFrame:
    """The table's own columns under their names, then ``new``.

    A column of the table that has the name of a new one is called that name
    with ``_in`` appended, as often as it takes to be free."""
    added = df.select(*new).columns
    taken, shown = {*added, *names}, []
    for name, c in names.items():
        to = name
        while to in added or (to != name and to in taken):
            to += "_in"
        taken.add(to)
        shown.append(F.col(c).alias(to))
    return df.select(*shown, *new)


def texts_of(batch: pa.RecordBatch, name: str = "__text") -> list[bytes]:
    """A batch's texts as UTF-8; a null is an empty text."""
    return [t or b"" for t in batch[name].cast(pa.binary()).to_pylist()]


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``rows`` rows, so that a worker holds few texts at once besides Arrow's own copy."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def per_worker(key: tuple, make: Callable):
    """What ``make`` returns, made once in each Python worker."""
    held = sys.__dict__.setdefault("_rastrum_held", {})
    if key not in held:
        held[key] = make()
    return held[key]


def with_row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Add ``__id`` and ``__tag``, neither ever null: the id, and a 64-bit hash of
    the text and of whether there is an id.

    Rows that share both are repeated rows; they get the same result from any
    operator, so one key for them is enough.
    """
    known = F.col(id_col).cast("long")
    return docs.withColumn("__tag", F.xxhash64(F.col(text_col), known.isNull())).withColumn("__id", F.coalesce(known, F.lit(-(1 << 63))))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable from each node of an undirected edge list.

    Min-label propagation with hooking of parents and pointer jumping; the
    rounds grow with the logarithm of the longest path.  Neighbour minima are
    partial aggregates, so a hub's edges are never gathered in one place.
    Returns (node, component); nodes without an edge are not in it.
    """
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("c")), "labels")
    while True:
        heard = both.join(labels.select(F.col("a").alias("b"), F.col("c").alias("said")), "b").groupBy("a").agg(F.min("said").alias("said"))
        told = labels.join(heard, "a")
        best = told.select("a", "said").unionByName(told.select(F.col("c").alias("a"), "said")).groupBy("a").agg(F.min("said").alias("said"))
        hooked = materialize(labels.join(best, "a", "left").select("a", F.col("c").alias("old"), F.least("c", "said").alias("c")), "labels")
        jumped = hooked.join(hooked.select(F.col("a").alias("c"), F.col("c").alias("top")), "c").select("a", "old", F.least("c", "top").alias("c"))
        before, labels = labels, materialize(jumped, "labels")
        discard(before, hooked)
        if labels.where("c <> old").isEmpty():
            discard(both)
            return labels.select(F.col("a").alias("node"), F.col("c").alias("component"))
