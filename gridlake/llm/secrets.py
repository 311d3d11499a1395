"""Secrets in texts, told apart by how many owners hold them; DataFrame functions only.

A scan finds candidate spans with regular expressions.  Hashes of their values are counted
over the whole corpus by distinct repositories and owners: a value that many owners hold
is a copied example, one that a single owner holds and that looks random is a live-looking
credential.  High-entropy strings without any other mark are reported only when live-looking.

Copies of a value within a repository meet before the exchange (partial aggregates); the
verdicts go back to the candidates by a join on the value's hash, whose hot values Spark
splits.  Texts are read once and never exchanged; the scan's spans are written to the
shared folder.

Defined results: null counts as an empty text and has no spans; null repositories or owners
count as one; repeated rows are separate rows; an empty table gives no rows; other columns, whatever
their names, are never read.  The places of n matches in one text, however long, take n log n steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage

# Base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{14,})"
HEX = r"([0-9a-f]{16,})"
# Marks of providers' own credentials.
PROVIDER = (
    r"(gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}"
    r"|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]*PRIVATE KEY-----)"
)
GENERIC = r"([A-Za-z0-9+/_-]{24,})"
KINDS = ("assign", "access", "hex", "provider", "generic")
BASE = 3
#: values held by this many owners or more are copied examples
COPIED = 3
#: distinct characters a random-looking value has at least
VARIED = 10

_SPANS = "array<struct<start:int,rank:int,end:int,value:string>>"


def _running(values: Column, combine, least: Column) -> Column:
    """Running totals of an array: each step combines values twice as far apart, so n values take n log n steps."""
    steps = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")
    shifts = F.transform(F.sequence(F.lit(0), steps), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return F.aggregate(
        shifts,
        values,
        lambda sums, shift: F.transform(sums, lambda x, i: combine(x, F.coalesce(F.get(sums, i - shift), least))),
    )


def _bound(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spans(text: Column, rank: int, pattern: str, group: int = 1, gate: Column | None = None) -> Column:
    """All matches of a pattern: leftmost, not overlapping, in code points."""
    found = F.struct(
        F.split(text, pattern, -1).alias("parts"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"),
    )

    def ends(x: Column) -> Column:
        steps = F.transform(x["matches"], lambda m, i: F.length(F.get(x["parts"], i)) + F.length(m))
        return F.struct(x["matches"].alias("matches"), x["values"].alias("values"), _running(steps, lambda a, b: a + b, F.lit(0)).alias("ends"))

    def spans(x: Column) -> Column:
        return F.transform(
            x["ends"],
            lambda end, i: F.struct(
                (end - F.length(F.get(x["matches"], i))).alias("start"),
                F.lit(rank).alias("rank"),
                end.alias("end"),
                F.get(x["values"], i).alias("value"),
            ),
        )

    hit = text.rlike(pattern) if gate is None else gate & text.rlike(pattern)
    return F.when(hit, _bound(_bound(found, ends), spans)).otherwise(F.array().cast(_SPANS))


def candidates(text: Column) -> Column:
    """Candidate spans of a text, base kinds first."""
    assign = _spans(text, 0, ASSIGN, 2, text.rlike(r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""))
    generic = F.filter(
        _spans(text, 4, GENERIC),
        lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]"),
    )
    return F.concat(
        F.filter(assign, lambda s: F.length(s["value"]) >= 12),
        _spans(text, 1, ACCESS, gate=text.contains("AKIA")),
        _spans(text, 2, HEX),
        _spans(text, 3, PROVIDER),
        generic,
    )


def _unmarked(found: Column) -> Column:
    """Spans in order, without the high-entropy ones that overlap a base span."""
    generic = len(KINDS) - 1
    never = F.lit((1 << 31) - 1)
    ends = F.transform(found, lambda s: F.when(s["rank"] < BASE, s["end"]).otherwise(F.lit(0)))
    starts = F.transform(F.reverse(found), lambda s: F.when(s["rank"] < BASE, s["start"]).otherwise(never))
    lined = F.struct(
        found.alias("found"),
        _running(ends, F.greatest, F.lit(0)).alias("ended"),  # furthest end of base spans so far
        F.reverse(_running(starts, F.least, never)).alias("begins"),  # first start of base spans from here
    )
    free = _bound(
        lined,
        lambda x: F.filter(
            x["found"],
            lambda s, i: (s["rank"] < generic) | ((F.get(x["ended"], i) <= s["start"]) & (F.get(x["begins"], i) >= s["end"])),
        ),
    )
    return F.when(F.exists(found, lambda s: s["rank"] == generic), free).otherwise(found)


def _looks_random(value: Column) -> Column:
    varied = F.size(F.array_distinct(F.split(value, ""))) >= VARIED
    return varied & value.rlike("[0-9]") & ~F.lower(value).rlike("example|sample|placeholder|changeme|xxxx|12345678")


def _joined(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def find_secrets(
    docs: DataFrame,
    repository: Column,
    owner: Column,
    copied: int = COPIED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id``, counts by base kind, ``base`` and ``spans`` as text, ``found`` with each span's verdict,
    ``n_live`` and ``n_copied``.

    ``repository`` and ``owner`` are columns of ``docs``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    scanned = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        text.alias("text"),
    ).select("doc_id", "repository", "owner", candidates(F.col("text")).alias("spans"))
    marked = F.transform(
        "spans",
        lambda s: F.struct(
            s["start"].alias("start"),
            s["rank"].alias("rank"),
            s["end"].alias("end"),
            F.xxhash64(s["value"]).alias("hash"),
            _looks_random(s["value"]).alias("random"),
        ),
    )
    scanned = stage(
        scanned.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repository", "owner", marked.alias("spans")),
        "secrets",
    )
    each = scanned.select("row", "repository", "owner", F.inline("spans"))
    held = each.select("hash", "owner", "repository").distinct()
    held = held.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    held = held.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    verdict = (
        F.when(F.col("owners") >= copied, "copied")
        .when((F.col("owners") == 1) & F.col("random"), "live")
        .otherwise("unclear")
    )
    judged = each.join(held, "hash").withColumn("verdict", verdict)
    judged = judged.where((F.col("rank") < len(KINDS) - 1) | (F.col("verdict") == "live"))
    entry = F.struct("start", "rank", "end", "owners", "repositories", "verdict")
    found = judged.groupBy("row").agg(F.sort_array(F.collect_list(entry)).alias("found"))
    out = scanned.select("row", "doc_id").join(found, "row", "left")
    out = out.withColumn("found", F.coalesce("found", F.filter(F.array(entry_of_nothing()), lambda s: F.lit(False))))
    out = out.withColumn("base", F.filter("found", lambda s: s["rank"] < BASE)).withColumn("found", _unmarked(F.col("found")))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    verdicts = lambda v: F.size(F.filter("found", lambda s: s["verdict"] == v)).cast("long")
    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        _joined(F.col("base")).alias("base"),
        _joined(F.col("found")).alias("spans"),
        verdicts("live").alias("n_live"),
        verdicts("copied").alias("n_copied"),
        "found",
    )


def entry_of_nothing() -> Column:
    return F.struct(
        F.lit(0).alias("start"),
        F.lit(0).alias("rank"),
        F.lit(0).alias("end"),
        F.lit(0).cast("long").alias("owners"),
        F.lit(0).cast("long").alias("repositories"),
        F.lit("").alias("verdict"),
    )
