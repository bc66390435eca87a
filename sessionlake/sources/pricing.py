"""Price tables: strict and lenient decoding, overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rate columns and the fields they are read from.
RATE_FIELDS = {
    "input": "input_cost_per_token",
    "output": "output_cost_per_token",
    "cache_write": "cache_creation_input_token_cost",
    "cache_read": "cache_read_input_token_cost",
    "input_200k": "input_cost_per_token_above_200k_tokens",
    "output_200k": "output_cost_per_token_above_200k_tokens",
    "cache_write_200k": "cache_creation_input_token_cost_above_200k_tokens",
    "cache_read_200k": "cache_read_input_token_cost_above_200k_tokens",
    "input_272k": "input_cost_per_token_above_272k_tokens",
    "output_272k": "output_cost_per_token_above_272k_tokens",
    "cache_write_272k": "cache_creation_input_token_cost_above_272k_tokens",
    "cache_read_272k": "cache_read_input_token_cost_above_272k_tokens",
}
TEMPLATE_MODEL = "sample_spec"
RATES = [*RATE_FIELDS, "fast"]
PRICING_SCHEMA = "model string, " + ", ".join(f"{name} double" for name in RATES)


class PricingError(ValueError):
    """A price file that strict decoding rejects."""


def load_pricing(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Price rows of a JSON object keyed by model.

    Entries without token rates are not models. Null, negative or non-numeric rates drop the entry,
    or raise in strict mode; strict mode also rejects a table without any priced model.
    """
    document = spark.read.option("wholetext", True).text(path)
    entries = document.select(F.explode(F.from_json("value", "map<string,variant>")).alias("model", "entry"))
    entries = entries.where(F.col("model") != TEMPLATE_MODEL)
    fields = F.expr("try_variant_get(entry, '$', 'map<string,variant>')")
    entries = entries.withColumn("fields", fields)
    named_in = F.map_contains_key("fields", RATE_FIELDS["input"])
    named_out = F.map_contains_key("fields", RATE_FIELDS["output"])
    is_object = F.col("fields").isNotNull()
    entries = entries.where(~is_object | named_in | named_out)
    rates = [
        F.expr(f"try_variant_get(entry, '$.{field}', 'double')").alias(name) for name, field in RATE_FIELDS.items()
    ]
    table = entries.select(
        "model",
        is_object.alias("is_object"),
        *[
            (F.map_contains_key("fields", field) & ~F.expr(f"coalesce(is_variant_null(fields['{field}']), true)"))
            .alias(f"has_{name}")
            for name, field in RATE_FIELDS.items()
        ],
        (named_in & F.expr(f"is_variant_null(fields['{RATE_FIELDS['input']}'])")).alias("null_input"),
        (named_out & F.expr(f"is_variant_null(fields['{RATE_FIELDS['output']}'])")).alias("null_output"),
        *rates,
        F.coalesce(F.expr("try_variant_get(entry, '$.provider_specific_entry.fast', 'double')"), F.lit(0.0)).alias("fast"),
    )
    good = F.col("is_object") & ~F.coalesce(F.col("null_input"), F.lit(False)) & ~F.coalesce(F.col("null_output"), F.lit(False))
    for name in RATE_FIELDS:
        rate = F.col(name)
        good = good & F.coalesce(
            ~F.col(f"has_{name}") | (rate.isNotNull() & (rate >= 0) & ~F.isnan(rate) & (rate != float("inf"))), F.lit(False)
        )
    good = good & (F.col("fast") >= 0)
    table = table.withColumn("good", F.coalesce(good, F.lit(False)))
    if strict:
        rejected = [row.model for row in table.where("NOT good").select("model").orderBy("model").take(5)]
        if rejected:
            raise PricingError(f"no usable rates for {', '.join(rejected)}")
        if table.where("good").isEmpty():
            raise PricingError("no model in the table is priced per token")
    priced = table.where("good").select(
        "model",
        F.coalesce("input", F.lit(0.0)).alias("input"),
        F.coalesce("output", F.lit(0.0)).alias("output"),
        *[name for name in RATES if name not in ("input", "output")],
    )
    return priced


def overlay_pricing(floor: DataFrame, overlay: DataFrame) -> DataFrame:
    """The overlay replaces the floor model by model; other floor models stay."""
    return floor.join(overlay.select("model"), "model", "left_anti").unionByName(overlay)
