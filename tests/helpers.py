"""Small helpers that several test modules share."""

from __future__ import annotations

import json


def lines(*records) -> str:
    return "\n".join(record if isinstance(record, str) else json.dumps(record, ensure_ascii=False) for record in records) + "\n"


def rows(frame, *columns, order=None):
    picked = frame.select(*columns) if columns else frame
    if order:
        picked = picked.orderBy(*([order] if isinstance(order, str) else order))
    return [tuple(row) for row in picked.collect()]
