"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Every text is searched for assignments, access keys and hexadecimal runs (the base kinds), and for long mixed
tokens. Values are hashed and counted over the corpus by distinct repositories and owners: a value that
several owners hold is a copied example, one that few owners hold looks live. Base spans always stay and carry
that class; a mixed token that overlaps no base span is added (kind ``owned``) if it looks live.

Positions are sums of the lengths of matches and of the gaps between them, in code points; they are taken in a
window over the matches of one row. Texts are read once; only matches are shuffled, and counts combine before
every shuffle, so a value that a third of all documents hold costs a few rows.

Defined cases: a null or empty text has no spans; repeated rows are separate rows; null owners and
repositories do not count as owners; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.plans.staging import stage

COPIED_OWNERS = 3
# The base kinds, in the order in which ties are listed.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # a run of fewer characters has no longer one inside
MIXED = "[A-Za-z0-9+/_-]{24,}"
_SHORTEST = (6, 20, 24, 24)


def _matches(text: Column, kind: int, pattern: str, group: int) -> Column:
    """All matches of one kind: gap before, length, hash of the value, whether it counts."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    zipped = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value"))

    def item(x: Column, at: Column) -> Column:
        counts = F.length(x["value"]) >= _SHORTEST[kind]
        if kind == 3:
            for needed in ("[0-9]", "[A-Z]", "[a-z]"):
                counts = counts & x["value"].rlike(needed)
        return F.struct(
            F.lit(kind).alias("kind"), at.alias("at"), F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("length"),
            F.when(counts, F.sha2(x["value"].cast("binary"), 256)).alias("hash"))

    return F.when(text.rlike(pattern), F.transform(zipped, item))


def scan(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id",
         copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """One row per row of ``docs``: ``repository``, and ``spans`` (start, kind, end, hash, live) sorted by start and kind."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    every = [_matches(text, 0, ASSIGN, 1), _matches(text, 1, ACCESS, 0), _matches(text, 2, HEX, 0), _matches(text, 3, MIXED, 0)]
    none = F.filter(F.array(F.struct(
        F.lit(0).alias("kind"), F.lit(0).alias("at"), F.lit(0).alias("gap"), F.lit(0).alias("length"), F.lit("").alias("hash"))), lambda x: F.lit(False))
    rows = stage(docs.select(
        F.monotonically_increasing_id().alias("row"),  # fixed by being written
        F.col(f"`{repository_col}`").alias("repository"),
        F.col(f"`{owner_col}`").cast("string").alias("owner"),
        F.concat(*[F.coalesce(kind, none) for kind in every]).alias("matches"),
    ), "secret-matches")
    one = Window.partitionBy("row", "kind").orderBy("at")
    found = (
        rows.select("row", "repository", "owner", F.explode("matches").alias("m")).select("row", "repository", "owner", "m.*")
        .withColumn("end", F.sum(F.col("gap") + F.col("length")).over(one))
        .where("hash IS NOT NULL")
        .select("row", "repository", "owner", "kind", (F.col("end") - F.col("length")).alias("start"), "end", "hash")
    )
    holders = (
        found.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("times"))
        .groupBy("hash", "owner").agg(F.count("repository").alias("repositories"))
        .groupBy("hash").agg(F.count("owner").alias("owners"), F.sum("repositories").alias("repositories"))
    )
    classed = found.join(holders, "hash").withColumn("live", F.col("owners") < copied_owners)
    place = Window.partitionBy("row").orderBy("start", "kind")
    base_end = F.max(F.when(F.col("kind") < 3, F.col("end"))).over(place.rowsBetween(Window.unboundedPreceding, -1))
    base_start = F.min(F.when(F.col("kind") < 3, F.col("start"))).over(place.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce(base_end, F.lit(0)) <= F.col("start")) & (F.coalesce(base_start, F.col("end")) >= F.col("end"))
    kept = classed.withColumn("clear", clear).where((F.col("kind") < 3) | (F.col("clear") & F.col("live")))
    spans = kept.groupBy("row").agg(F.sort_array(F.collect_list(
        F.struct("start", "kind", "end", "hash", "live", "owners", "repositories"))).alias("spans"))
    return rows.select("row", "repository").join(spans, "row", "left").select(
        "repository", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(name) for name in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """Base and added spans of every whole document, with the corpus-wide class of their values counted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    spans = F.col("spans")
    base = F.filter(spans, lambda x: x["kind"] < 3)

    def count(kind: int) -> Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")

    return scan(docs).select(
        F.col("repository").alias("doc_id"),
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
        F.size(F.filter(spans, lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter(spans, lambda x: ~x["live"])).cast("long").alias("n_copied"),
    )
