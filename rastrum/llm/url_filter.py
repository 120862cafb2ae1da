"""URL filters: list rules by host and path, else gradient-boosted trees.

The trees see lexical features only: lengths, depth, digit ratio, entropy,
parameter counts, and how often labelled URLs with the same host suffix are to
be blocked.  They are trained here, on about ``MOST_LABELLED`` labelled URLs at
most: all of a label that has up to half as many, else those whose hash is under
a limit, weighted so that both labels count as often as they occur.  The suffix
rates that a URL is trained with come from the other ``FOLDS`` - 1 folds of the
sample, so that its own label isn't among them.  Every URL is judged.

Defined results: a null URL, or one without ``://``, has an empty host and path
and fits no rule; repeated rows and null ids stay, a repeated labelled URL counts
once; without labels of both kinds what no rule decides is allowed; an empty
table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_LABELLED = 10_000
TREES, DEPTH, SEED = 12, 4, 7
#: A suffix without labelled URLs counts as so many URLs of the average.
PRIOR = 4.0
FOLDS = 5

# The rules (host and path) with their verdicts.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Seed words of a weak labelling: a host with one of them is to be blocked.
SEED_WORDS = ("casino", "bets", "pills", "spam", "adult", "ads-")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    fits = []
    for text, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own, slash, start = text.partition("/")
        fits.append(F.when(((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + start)), F.lit(text)))
    return F.coalesce(*fits, F.lit(None))


def lexical(url: str, host: str, path: str) -> list[float]:
    query = url.partition("#")[0].partition("?")[2]
    n = max(len(url), 1)
    counts = Counter(url)
    return [
        float(len(url)),
        float(len(host)),
        float(path.count("/")),
        sum(c.isdigit() for c in url) / n,
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        float(len([p for p in query.split("&") if p])),
        float(host.count(".")),
        float(host.count("-")),
        float("#" in url),
    ]


_LEXICAL = ("length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "dots", "hyphens", "fragment")


def _featured(urls: DataFrame) -> DataFrame:
    """Adds __host, __path, the lexical features and the host's suffixes of two and three labels."""
    wide = urls.withColumns({"__host": host_of(F.col("__url")), "__path": path_of(F.col("__url"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [lexical(u or "", h, p) for u, h, p in zip(b["__url"].to_pylist(), b["__host"].to_pylist(), b["__path"].to_pylist(), strict=True)]
            new = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(_LEXICAL))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *(f"__{c}" for c in _LEXICAL)])

    wide = wide.mapInArrow(run, T.StructType([*wide.schema.fields, *(T.StructField(f"__{c}", T.DoubleType()) for c in _LEXICAL)]))
    return wide.withColumns({f"__suffix{k}": F.substring_index("__host", ".", -k) for k in (2, 3)})


def _with_rates(df: DataFrame, rates: dict[int, DataFrame], prior: float) -> DataFrame:
    for k, table in rates.items():
        df = df.join(F.broadcast(table), f"__suffix{k}", "left").fillna({f"__rate{k}": prior, f"__seen{k}": 0.0})
    return df


def suffix_rates(held: pd.DataFrame, k: int, prior: float) -> pd.DataFrame:
    """(suffix, rate, seen) of a sample (__suffix<k>, __label, __weight)."""
    marked = held.assign(bad=held["__label"] * held["__weight"])
    seen = marked.groupby(f"__suffix{k}")[["bad", "__weight"]].sum().reset_index()
    seen[f"__rate{k}"] = (seen["bad"] + PRIOR * prior) / (seen["__weight"] + PRIOR)
    seen[f"__seen{k}"] = seen["__weight"].astype(float)
    return seen[[f"__suffix{k}", f"__rate{k}", f"__seen{k}"]]


def sample_of(labelled: DataFrame, url_col: str, label_col: str, most: int) -> pd.DataFrame:
    """(__url, __label, __weight) of about ``most`` distinct URLs at most."""
    rows = labelled.select(F.col(url_col).cast("string").alias("__url"), F.col(label_col).cast("double").alias("__label")).dropna()
    counts = {r["__label"]: r["n"] for r in rows.groupBy("__label").agg(F.count("*").alias("n")).collect()}  # one row per label
    under = F.lit(False)
    for label, n in counts.items():
        limit = min(1 << 31, -(-((most // 2) << 31) // n))
        under = under | ((F.col("__label") == label) & (F.pmod(F.xxhash64("__url"), F.lit(1 << 31)) < limit))
    picked = rows.where(under).distinct().orderBy("__url", "__label").toPandas()  # about most // 2 rows of each label at most
    took = picked["__label"].value_counts()
    picked["__weight"] = [counts[x] / took[x] / sum(counts.values()) * len(picked) for x in picked["__label"]]
    return picked


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", most: int = MOST_LABELLED):
    """(model, suffix rates, prior) from labelled URLs, or None if only one label occurs."""
    picked = sample_of(labelled, url_col, label_col, most)
    if picked["__label"].nunique() < 2:
        return None
    spark = labelled.sparkSession
    held = _featured(spark.createDataFrame(picked, "__url string, __label double, __weight double").coalesce(1)).toPandas()
    prior = float((held["__label"] * held["__weight"]).sum() / held["__weight"].sum())
    rates = {k: spark.createDataFrame(suffix_rates(held, k, prior), f"__suffix{k} string, __rate{k} double, __seen{k} double") for k in (2, 3)}  # at most one row per labelled URL
    fold = held["__url"].map(lambda u: zlib.crc32(u.encode()) % FOLDS)
    ready = []
    for f in range(FOLDS):
        own = held[fold == f]
        for k in (2, 3):
            own = own.merge(suffix_rates(held[fold != f], k, prior), "left", f"__suffix{k}")
            own = own.fillna({f"__rate{k}": prior, f"__seen{k}": 0.0})
        ready.append(own)
    rows = pd.concat(ready)
    model = GBTClassifier(featuresCol="__features", labelCol="__label", weightCol="__weight", predictionCol="__blocked", maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=32)
    return model.fit(_assembler().transform(spark.createDataFrame(rows).coalesce(1))), rates, prior


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=[*(f"__{c}" for c in _LEXICAL), "__rate2", "__seen2", "__rate3", "__seen3"], outputCol="__features")


def judge(pages: DataFrame, labelled: DataFrame, url_col: str = "url", rules=RULES, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` with host, path, rule and verdict of every URL."""
    trained = train(labelled)
    rows = _featured(pages.select(*keep, F.col(url_col).cast("string").alias("__url")))
    if trained is None:
        scored = rows.withColumn("__blocked", F.lit(0.0))
    else:
        model, rates, prior = trained
        scored = model.transform(_assembler().transform(_with_rates(rows, rates, prior)))
    rule = rule_of(F.col("__host"), F.col("__path"), rules)
    verdict = F.coalesce(*(F.when(F.col("rule") == text, F.lit(v)) for text, v in rules), F.when(F.col("__blocked") > 0.5, "block").otherwise("allow"))
    return scored.select(*keep, F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), F.col("__blocked")).withColumn("verdict", verdict).drop("__blocked")


def weak_labels(pages: DataFrame, url_col: str = "url", words=SEED_WORDS) -> DataFrame:
    """(url, blocked): 1 where the host has a seed word."""
    host = host_of(F.col(url_col))
    bad = F.lit(False)
    for w in words:
        bad = bad | F.contains(host, F.lit(w))
    return pages.where(F.contains(F.col(url_col), F.lit("://"))).select(F.col(url_col).alias("url"), bad.cast("int").alias("blocked"))
