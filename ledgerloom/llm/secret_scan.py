"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base candidates are found by three expressions (assign, access, hex); a weaker shape
(long tokens of mixed classes) is a candidate too.  Every candidate value is hashed
and counted over the whole corpus by distinct repositories and owners.  A value held
by at most LIVE_OWNERS owners is live-looking; a value held by more is a widely
copied example, in however many repositories.  Weak candidates become spans (kind `live`) only when they are
live-looking; base spans always stay and carry their class.

Positions come from SQL alone: the lengths of the pieces that split() leaves between
matches and of the matches themselves add up to code-point offsets.

The scan shuffles hashes and ids, never texts; redact() moves texts too where the
live values are too many to be broadcast.  Counts are pre-aggregated by (value, owner,
repository) before the per-value count, and live values meet their repositories in
SALTS parts each, so one value in a third of all rows is not gathered in one task.

Edge cases: a null text is empty; a null repository or owner counts as one of its
own; rows with the same id keep separate results; empty tables give empty results;
input columns named like an output are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm import shared

# The candidate expressions and limits.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
WEAK = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}"
ASSIGN_LEAST = 8
LIVE_OWNERS = 2
SALTS = 16
KINDS = ("assign", "access", "hex", "live")

_SPAN = "array<struct<start:int,rank:int,end:int,hash:bigint>>"


def _spans(text: Column, rank: int, pattern: str, group: int, ok) -> Column:
    """Spans of all matches that pass `ok`, in order."""
    none = F.array().cast(_SPAN)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    start = F.aggregate(
        F.arrays_zip(found.alias("m"), value.alias("v"), F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("p")),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at"),
            F.concat(
                a["out"],
                F.when(
                    ok(x["v"]),
                    F.array(
                        F.struct(
                            (a["at"] + F.length(x["p"])).alias("start"),
                            F.lit(rank).alias("rank"),
                            (a["at"] + F.length(x["p"]) + F.length(x["m"])).alias("end"),
                            F.xxhash64(x["v"], F.lit(17)).alias("hash"),
                        )
                    ),
                ).otherwise(none),
            ).cast(_SPAN).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(text.rlike(pattern), start).otherwise(none)


def candidates(docs: DataFrame, text: str, repository: str, owner: str) -> DataFrame:
    """(_id, _repo, _owner, _base, _weak): candidate spans of every row; no shuffle."""
    rows = docs.select(F.col(f"`{repository}`").alias("_repo"), F.col(f"`{owner}`").alias("_owner"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    assign, access, hexes, weak = _all_spans(F.col("_t"))
    return rows.select("_repo", "_owner", F.sort_array(F.concat(assign, access, hexes)).alias("_base"), weak.alias("_weak"))


def _all_spans(t: Column) -> list[Column]:
    """The candidate spans of a text, by kind."""
    none = F.array().cast(_SPAN)
    assign = F.when(t.contains("=") | t.contains(":"), _spans(t, 0, ASSIGN, 1, lambda v: F.length(v) >= ASSIGN_LEAST)).otherwise(none)
    access = F.when(t.contains("AKIA"), _spans(t, 1, ACCESS, 0, lambda v: F.lit(True))).otherwise(none)
    hexes = _spans(t, 2, HEX, 0, lambda v: F.lit(True))
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]") & (F.size(F.array_distinct(F.split(v, ""))) >= 12)
    return [assign, access, hexes, _spans(t, 3, WEAK, 0, mixed)]


def ownership(found: DataFrame) -> DataFrame:
    """Distinct repositories and owners of every candidate value: (hash, n_repositories, n_owners, live)."""
    each = found.select("_repo", "_owner", F.explode(F.concat("_base", "_weak")["hash"]).alias("hash"))
    return (
        each.groupBy("hash", "_owner", "_repo").agg(F.lit(1).alias("_one"))
        .groupBy("hash", "_owner").agg(F.count("*").alias("_repos"))
        .groupBy("hash").agg(F.sum("_repos").alias("n_repositories"), F.count("*").alias("n_owners"))
        .withColumn("live", F.col("n_owners") <= LIVE_OWNERS)
    )


def _live_of(found: DataFrame) -> DataFrame:
    """(_key, _live): the live-looking hashes of every repository that has a candidate."""
    return (
        found.where((F.size("_base") > 0) | (F.size("_weak") > 0))
        .select("_repo", F.pmod(F.xxhash64("_repo"), F.lit(SALTS)).cast("int").alias("_salt"), F.explode(F.array_distinct(F.concat("_base", "_weak")["hash"])).alias("hash"))
        .join(ownership(found).where("live").select("hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")), ["hash", "_salt"])
        .groupBy("_repo")
        .agg(F.collect_set("hash").alias("_live"))
        .withColumnRenamed("_repo", "_key")
    )


def redact(docs: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every live-looking credential in `text` replaced by `mark`; widely copied examples stay.

    Only ids and hashes decide; a row's spans are found again in its own text, so rows
    that share an id are each redacted rightly.
    """
    found = shared.written(candidates(docs, text, repository, owner), "secrets")
    key, held = shared.fresh(docs, "_key"), shared.fresh(docs, "_live")
    live = _live_of(found).select(F.col("_key").alias(key), F.col("_live").alias(held))
    rows = docs.join(live, F.col(f"`{repository}`").eqNullSafe(F.col(key)), "left")
    t = F.col(f"`{text}`")
    spans = F.sort_array(F.filter(F.concat(*_all_spans(t)), lambda x: F.array_contains(held, x["hash"])))
    cleaned = F.when(F.col(held).isNotNull() & t.isNotNull(), redacted(t, spans, mark)).otherwise(t)
    return rows.select(*(cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))


def scan(docs: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row for each row of `docs`: repository, owner, base spans, and all spans with their class.

    base: array<struct<start, rank, end, hash>>; spans: the same with `live`.
    """
    found = shared.written(candidates(docs, text, repository, owner), "secrets")
    held = _live_of(found)
    joined = found.join(held, F.col("_repo").eqNullSafe(F.col("_key")), "left")
    live = F.coalesce(F.col("_live"), F.array().cast("array<bigint>"))
    marked = lambda s: F.transform(s, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["hash"].alias("hash"), F.array_contains(live, x["hash"]).alias("live")))
    clear = lambda x: ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    added = F.filter(marked("_weak"), lambda x: x["live"] & clear(x))
    return joined.select(F.col("_repo").alias("repository"), F.col("_owner").alias("owner"), F.col("_base").alias("base"), F.sort_array(F.concat(marked("_base"), added)).alias("spans"))


def rendered(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    name = lambda r: reduce(lambda out, k: out.when(r == k[0], k[1]), list(enumerate(KINDS))[1:], F.when(r == 0, KINDS[0]))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["rank"]), x["start"], x["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones together, replaced by `mark`."""
    state = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["at"], x["end"]).alias("at"),
            F.when(x["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out"),
        ),
    )
    done = state["out"]
    return F.when(F.size(spans) > 0, F.concat(done, F.substring(text, F.array_max(F.transform(spans, lambda x: x["end"])) + 1, F.length(text)))).otherwise(text)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: counts, the digest of base spans, all spans, live and example counts of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = scan(docs)
    of = lambda r: F.size(F.filter("base", lambda x: x["rank"] == r)).cast("long")
    return found.select(
        F.col("repository").alias("doc_id"),
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(rendered(F.col("base")), 256).alias("base_sha256"),
        rendered(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda x: ~x["live"])).cast("long").alias("n_example"),
    )
