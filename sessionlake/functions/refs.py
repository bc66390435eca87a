"""Canonical references of session nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What form encoding writes, and what a path segment keeps.
FORM_TO_PATH = [
    ("+", "%20"),
    ("*", "%2A"),
    ("%7E", "~"),
    ("%24", "$"),
    ("%26", "&"),
    ("%2B", "+"),
    ("%3D", "="),
    ("%3A", ":"),
    ("%40", "@"),
]


def escape_component(column: Column) -> Column:
    """Percent-encode one path segment."""
    encoded = F.url_encode(column)
    for form, path in FORM_TO_PATH:
        encoded = F.replace(encoded, F.lit(form), F.lit(path))
    return encoded


def escape_path(column: Column) -> Column:
    """Percent-encode every segment of a slash-separated path."""
    return F.array_join(F.transform(F.split(column, "/"), escape_component), "/")


def root_ref(agent: Column, session_id: Column) -> Column:
    return F.concat(agent, F.lit(":"), escape_component(session_id))
