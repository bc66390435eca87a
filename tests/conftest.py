"""Shared Spark session and transcript fixtures with invented content."""

from __future__ import annotations

import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def price_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("prices") / "prices.json"
    path.write_text(json.dumps({
        "sample_spec": {"input_cost_per_token": 1, "output_cost_per_token": 1},
        "oak-1": {"input_cost_per_token": 3e-6, "output_cost_per_token": 1.5e-5, "cache_read_input_token_cost": 3e-7},
        "anthropic/elm-2": {"input_cost_per_token": 1e-6, "output_cost_per_token": 5e-6,
                            "input_cost_per_token_above_200k_tokens": 2e-6},
        "elm-2-fast": {"input_cost_per_token": 4e-6, "output_cost_per_token": 2e-5, "provider_specific_entry": {"fast": 2.0}},
        "openai/gpt-5": {"input_cost_per_token": 2e-6, "output_cost_per_token": 8e-6, "cache_read_input_token_cost": 2e-7},
        "no-rates": {"mode": "image"},
        "negative": {"input_cost_per_token": -1, "output_cost_per_token": 1},
        "null-rate": {"input_cost_per_token": None, "output_cost_per_token": 1},
        "text": {"input_cost_per_token": "x", "output_cost_per_token": 1},
    }))
    return str(path)


@pytest.fixture(scope="session")
def prices(spark, price_file):
    from sessionlake.sources.pricing import load_pricing

    return load_pricing(spark, price_file).cache()
