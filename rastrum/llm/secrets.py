"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression yields a Boolean trigram query: an AND of
clauses, each an OR of trigram sets that must occur together.  The index holds
(trigram, document) postings for the trigrams the rules ask for; intersecting
the postings gives candidate (document, rule) pairs, and only candidates are
verified with the regular expression.  A rule without a mandatory trigram is
verified on every document.

Defined results: a null text is an empty text; a null id is an ordinary id;
repeated rows give repeated, equal results; an empty table gives no rows; other
columns are left alone, one called ``secret_spans`` gets ``_in`` appended.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as ops
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrum.llm.common import materialize, unveiled, veiled, with_row_key


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those whose ``group``
    has fewer than ``at_least`` characters are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 1
    base: bool = False


# The base kinds and public formats of well-known credentials.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 36),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

MOST_STRINGS = 64
#: Size of the table that says which texts may have candidate rules.
BITS = 1 << 20


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _clause(strings: set[str]) -> list[frozenset[str]]:
    """Alternatives of trigrams that must occur together; none if some string is too short."""
    if not strings or min(map(len, strings)) < 3:
        return []
    sets = {_trigrams(s) for s in strings}
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


def _exact(tree) -> set[str] | None:
    """All strings a small pattern can match, or None."""
    got = {""}
    for op, arg in tree:
        if op is ops.LITERAL:
            more = {chr(arg).lower()}
        elif op is ops.IN:
            if any(o is not ops.LITERAL for o, _ in arg):
                return None
            more = {chr(c).lower() for _, c in arg}
        elif op is ops.SUBPATTERN:
            more = _exact(arg[3])
        elif op is ops.BRANCH:
            parts = [_exact(x) for x in arg[1]]
            more = None if None in parts else set().union(*parts)
        elif op is ops.MAX_REPEAT and arg[1] == 1:
            more = _exact(arg[2])
            more = more if more is None or arg[0] else more | {""}
        else:
            return None
        if more is None or len(got) * len(more) > MOST_STRINGS:
            return None
        got = {a + b for a in got for b in more}
    return got


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses that every match satisfies, over lower-cased text; [] if there are none."""
    clauses, run = [], {""}

    def close() -> None:
        nonlocal run
        if clause := _clause(run):
            clauses.append(clause)
        run = {""}

    for item in parser.parse(pattern):
        strings = _exact([item])
        if strings is not None:
            if len(run) * len(strings) > MOST_STRINGS:
                close()
            run = {a + b for a in run for b in strings}
            continue
        op, arg = item
        once = _exact(arg[2]) if op is ops.MAX_REPEAT and arg[0] >= 1 else None
        if once is not None and len(run) * len(once) <= MOST_STRINGS:
            run = {a + b for a in run for b in once}
        close()
    close()
    return clauses


def candidates(docs: DataFrame, rules=RULES, text_col: str = "__text") -> DataFrame:
    """(__id, __tag, kinds): the rules whose trigram query a document's postings satisfy."""
    spark = docs.sparkSession
    terms = [
        (rule.kind, c, a, trigram, len(alt))
        for rule in rules
        for c, clause in enumerate(trigram_query(rule.pattern))
        for a, alt in enumerate(clause)
        for trigram in sorted(alt)
    ]
    clauses = [(rule.kind, n) for rule in rules if (n := len(trigram_query(rule.pattern)))]
    terms = spark.createDataFrame(terms, "kind string, clause int, alt int, trigram string, needed int")
    clauses = spark.createDataFrame(clauses, "kind string, n_clauses int")
    vocabulary = sorted({t for r in rules for c in trigram_query(r.pattern) for alt in c for t in alt})
    found = F.array_compact(F.array(*(F.when(F.contains(F.col("__low"), F.lit(t)), F.lit(t)) for t in vocabulary)))
    postings = docs.select("__id", "__tag", F.lower(text_col).alias("__low")).select(F.explode(found).alias("trigram"), "__id", "__tag")
    met = (
        postings.join(F.broadcast(terms), "trigram")  # as many rows as the rules have trigrams
        .groupBy("__id", "__tag", "kind", "clause", "alt", "needed")
        .agg(F.size(F.collect_set("trigram")).alias("got"))
        .where("got = needed")
    )
    return (
        met.groupBy("__id", "__tag", "kind")
        .agg(F.size(F.collect_set("clause")).alias("got"))
        .join(F.broadcast(clauses), "kind")
        .where("got = n_clauses")
        .groupBy("__id", "__tag")
        .agg(F.collect_set("kind").alias("__kinds"))
    )


_SPAN = "array<struct<start:int,rank:int,stop:int,kind:string>>"


def _spans(rule: Rule, rank: int, matches: Column, pieces: Column) -> Column:
    """Offsets in code points from the pieces between matches."""
    size_of = F.char_length if not rule.group else (lambda m: F.char_length(F.regexp_extract(m, rule.pattern, rule.group)))
    parts = F.zip_with(
        F.slice(pieces, 1, F.size(matches)),
        matches,
        lambda p, m: F.struct(F.char_length(p).alias("gap"), F.char_length(m).alias("len"), (size_of(m) >= rule.at_least).alias("ok")),
    )
    start = lambda acc, x: acc["at"] + x["gap"]
    walked = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")),
        lambda acc, x: F.struct(
            (start(acc, x) + x["len"]).alias("at"),
            F.when(
                x["ok"],
                F.concat(
                    acc["out"],
                    F.array(F.struct(start(acc, x).alias("start"), F.lit(rank).alias("rank"), (start(acc, x) + x["len"]).alias("stop"), F.lit(rule.kind).alias("kind"))),
                ),
            ).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return walked


def _bit() -> Column:
    return F.pmod(F.xxhash64("__id", "__tag"), F.lit(BITS)).cast("int")


def _verified(docs: DataFrame, rules, kinds: Column | None) -> DataFrame:
    """Adds ``__spans``; without ``kinds`` only rules that every text is verified with are tried."""
    spans, none, out = [], F.array().cast("array<string>"), docs
    for i, rule in enumerate(rules):
        indexed = bool(trigram_query(rule.pattern))
        if indexed and kinds is None:
            continue
        # a run of a class that stays below the minimum can't be a match: leave it to the matcher
        pattern = rule.pattern
        if not rule.group and pattern.endswith("]+") and pattern.startswith("[") and pattern.count("[") == 1:
            pattern = f"{pattern[:-1]}{{{rule.at_least},}}"
        hits = F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))
        if indexed:
            hits = F.when(F.array_contains(kinds, rule.kind), hits).otherwise(none)
        out = out.withColumn(f"__m{i}", hits)
        out = out.withColumn(f"__p{i}", F.when(F.size(f"__m{i}") > 0, F.split("__text", pattern, -1)).otherwise(none))
        spans.append(F.when(F.size(f"__m{i}") > 0, _spans(rule, i, F.col(f"__m{i}"), F.col(f"__p{i}"))).otherwise(F.array().cast(_SPAN)))
    return out.withColumn("__spans", F.array_sort(F.concat(F.array().cast(_SPAN), *spans))).select(*docs.columns, "__spans")


def _scan(docs: DataFrame, id_col: str, rules) -> DataFrame:
    """Adds ``__spans``.  Candidates' keys go to a table of ``BITS`` bits; only texts
    whose bit is set are shuffled, to meet their candidate rules."""
    base = with_row_key(docs, id_col, "__text").withColumn("__bit", _bit())
    kinds = materialize(candidates(base, rules), "candidates")
    some = F.broadcast(kinds.select(_bit().alias("__bit")).distinct())  # BITS rows at most
    rest = base.join(some, "__bit", "left_anti").select(*base.columns)
    few = base.join(some, "__bit", "left_semi").select(*base.columns).join(kinds, ["__id", "__tag"], "left")
    met = _verified(few, rules, F.col("__kinds")).select(*base.columns, "__spans")
    return _verified(rest, rules, None).unionByName(met)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """The documents' rows with ``secret_spans``, an array of (start, rank, stop,
    kind) sorted by start, then rule order; code points, end exclusive."""
    own, names = veiled(docs)
    found = _scan(own.withColumn("__text", F.coalesce(F.col(names[text_col]).cast("string"), F.lit(""))), names[id_col], rules)
    return unveiled(found, names, F.col("__spans").alias("secret_spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", rules=RULES) -> DataFrame:
    """The documents with every secret replaced by ``mark``; overlapping spans
    become one.  Keeps the table's columns; ``n_chars``, if there, follows the
    text.  A null text stays null."""
    own, names = veiled(docs)
    text = names[text_col]
    found = _scan(own.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit(""))), names[id_col], rules)
    cut = F.aggregate(
        "__spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"])
            .otherwise(F.concat(acc["out"], F.substring(F.col("__text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
            .alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("__text"), acc["at"] + 1, F.char_length(F.col("__text")))),
    )
    found = found.withColumn(text, F.when(F.col(text).isNull(), F.lit(None)).when(F.size("__spans") == 0, F.col(text)).otherwise(cut))
    if "n_chars" in names:
        found = found.withColumn(names["n_chars"], F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return unveiled(found, names)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest columns of a scan."""
    show = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))
    base = [r.kind for r in RULES if r.base]
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        id_col,
        *(count(k).alias(f"n_{k}") for k in base),
        F.sha2(show(F.filter("secret_spans", lambda s: s["rank"] < len(base))), 256).alias("base_sha256"),
        show(F.col("secret_spans")).alias("spans"),
    )
