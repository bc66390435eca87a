"""Resolve prices and price requests, before any aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.tokens import uncached_input
from sessionlake.plans.joins import broadcast_if_small
from sessionlake.sources.pricing import RATES

# Fixed values.
KEY_PREFIXES = ["", "anthropic.", "anthropic/", "openai/"]
STANDIN_SUFFIXES = ["-sol", "-terra", "-luna"]
STANDIN_FAMILY = "gpt-5"
FAST = "fast"
FAST_SUFFIX = "-fast"
LOW_TIER, HIGH_TIER = 200_000, 272_000
WRITE_FACTOR, READ_FACTOR, HOUR_WRITE_FACTOR = 1.25, 0.1, 2

CODEX = "codex"


def price_lookup(pricing: DataFrame) -> DataFrame:
    """One row per loggable model name: the first price key that serves it.

    Built from the price table alone, so it holds at most four rows per priced model whatever the
    number of requests.
    """
    keys = F.array(
        *[
            F.when(
                F.startswith("model", F.lit(prefix)),
                F.struct(
                    F.substring(F.col("model"), len(prefix) + 1, 1_000_000).alias("name"), F.lit(at).alias("rank")
                ),
            )
            for at, prefix in enumerate(KEY_PREFIXES)
        ]
    )
    rows = pricing.select("*", F.explode(F.array_compact(keys)).alias("key"))
    packed = F.struct(F.col("model").alias("pricing_model"), *RATES)
    return rows.groupBy(F.col("key.name").alias("name")).agg(F.min_by(packed, F.col("key.rank")).alias("price"))


def _standin_base() -> Column:
    bare = F.regexp_replace("model", r"\Aopenai/", "")
    base = F.lit(None).cast("string")
    for suffix in reversed(STANDIN_SUFFIXES):
        base = F.when(F.endswith("model", F.lit(suffix)), F.regexp_replace("model", f"{suffix}$", "")).otherwise(base)
    return F.when(F.startswith(bare, F.lit(STANDIN_FAMILY)), base)


def resolve_prices(requests: DataFrame, pricing: DataFrame, default_model: str | None = None) -> DataFrame:
    """Add ``price`` (rates), ``pricing_model``, ``exact`` and ``priced`` to every request.

    A fast request looks for its ``-fast`` entry first. A request of the second format may fall
    back to the base of a private variant, then to ``default_model``; such a price is not exact.
    The joins look a request up in the price table, so requests are never shuffled by model.
    """
    lookup = broadcast_if_small(price_lookup(pricing))
    is_fast = F.coalesce(F.col("speed"), F.lit("")) == FAST
    codex = F.col("agent") == CODEX
    wanted = {
        "fast": F.when(is_fast & ~F.endswith("model", F.lit(FAST_SUFFIX)), F.concat("model", F.lit(FAST_SUFFIX))),
        "own": F.col("model"),
        "base": F.when(codex, _standin_base()),
        "default": F.when(codex, F.lit(default_model).cast("string")),
    }
    out = requests
    for step, name in wanted.items():
        if step == "default" and default_model is None:
            continue
        side = lookup.select(F.col("name").alias(f"__n_{step}"), F.col("price").alias(f"__p_{step}"))
        out = out.withColumn(f"__n_{step}", name).join(side, f"__n_{step}", "left").drop(f"__n_{step}")
    found = [f"__p_{step}" for step in wanted if f"__p_{step}" in out.columns]
    own = F.coalesce("__p_fast", "__p_own")
    return (
        out.withColumn("price", F.coalesce(*found))
        .withColumn("exact", own.isNotNull())
        .withColumn("pricing_model", F.col("price.pricing_model"))
        .withColumn("priced", F.col("price").isNotNull())
        .drop(*found)
    )


def _rate(name: str) -> Column:
    return F.col(f"price.{name}")


def _category_rates() -> dict[str, tuple[Column, Column, Column]]:
    """Base, above-200k and above-272k rate of every billed category."""
    return {
        "input": (_rate("input"), _rate("input_200k"), _rate("input_272k")),
        "output": (_rate("output"), _rate("output_200k"), _rate("output_272k")),
        "write_5m": (
            F.coalesce(_rate("cache_write"), _rate("input") * WRITE_FACTOR),
            _rate("cache_write_200k"),
            _rate("cache_write_272k"),
        ),
        "cache_read": (
            F.coalesce(_rate("cache_read"), _rate("input") * READ_FACTOR),
            _rate("cache_read_200k"),
            _rate("cache_read_272k"),
        ),
        "write_1h": (
            _rate("input") * HOUR_WRITE_FACTOR,
            _rate("input_200k") * HOUR_WRITE_FACTOR,
            _rate("input_272k") * HOUR_WRITE_FACTOR,
        ),
    }


def _tokens(category: str) -> Column:
    return uncached_input(F.col) if category == "input" else F.col(category)


def tiered_price(tokens: Column, base: Column, above_200k: Column, above_272k: Column) -> Column:
    """Marginal tier: only tokens beyond the threshold use the upper rate."""
    above = F.coalesce(above_200k, above_272k)
    threshold = F.when(above_200k.isNotNull(), F.lit(LOW_TIER)).otherwise(F.lit(HIGH_TIER))
    return F.when(above.isNull() | (tokens <= threshold), tokens * base).otherwise(
        threshold * base + (tokens - threshold) * above
    )


def _multiplier() -> Column:
    fast = _rate("fast")
    return F.when((F.coalesce(F.col("speed"), F.lit("")) == FAST) & (F.coalesce(fast, F.lit(0.0)) != 0), fast).otherwise(1.0)


def rate_cost() -> Column:
    """Price of a resolved request by its rates, ignoring a logged cost."""
    rates = _category_rates()
    total = None
    for category in ["input", "output", "write_5m", "cache_read", "write_1h"]:
        part = tiered_price(_tokens(category), *rates[category])
        total = part if total is None else total + part
    return total * _multiplier()


def price_requests(requests: DataFrame, pricing: DataFrame, default_model: str | None = None) -> DataFrame:
    """Add ``usd``, ``priced``, ``exact``, ``estimated``, ``missing`` and ``pricing_model``.

    Tier thresholds hold per request, so this runs below every aggregation. A logged cost wins over
    the rates.
    """
    resolved = resolve_prices(requests, pricing, default_model)
    codex = F.col("agent") == CODEX
    usable = F.col("cost_usd").isNotNull() & (~codex | F.col("priced"))
    return (
        resolved.withColumn(
            "usd",
            F.when(usable, F.col("cost_usd")).when(F.col("priced"), rate_cost()).otherwise(F.lit(0.0)),
        )
        .withColumn("missing", ~F.col("priced") & ~usable)
        .withColumn("estimated", codex & ~F.col("exact"))
    )


def request_buckets(priced: DataFrame) -> DataFrame:
    """Every priced request as ``(category, rate, tokens, above)`` rows, one per rate applied."""
    rates = _category_rates()
    names = {"input": "input", "output": "output", "write_5m": "cache_write", "write_1h": "cache_write", "cache_read": "cache_read"}
    factor = _multiplier()
    cells = []
    for category, label in names.items():
        base, low, high = rates[category]
        tokens = _tokens(category)
        above = F.coalesce(low, high)
        threshold = F.when(low.isNotNull(), F.lit(LOW_TIER)).otherwise(F.lit(HIGH_TIER)).cast("bigint")
        split = above.isNotNull() & (tokens > threshold)
        first = F.struct(
            F.lit(label).alias("category"),
            (base * factor).alias("rate"),
            F.when(split, threshold).otherwise(tokens).alias("tokens"),
            F.lit(False).alias("above"),
        )
        second = F.struct(
            F.lit(label).alias("category"),
            (above * factor).alias("rate"),
            (tokens - threshold).alias("tokens"),
            F.lit(True).alias("above"),
        )
        cells += [F.when(tokens > 0, first), F.when(split, second)]
    exploded = priced.where("priced").withColumn("bucket", F.explode(F.array_compact(F.array(*cells))))
    return exploded.select("*", "bucket.*").drop("bucket")


def cost_buckets(priced: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Buckets merged by equal rate per ``by``, model and category; ``above`` only if all parts are."""
    by = by or ["node_id", "model"]
    return request_buckets(priced).groupBy(*by, "category", "rate").agg(
        F.sum("tokens").alias("tokens"), F.bool_and("above").alias("above")
    )
