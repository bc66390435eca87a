"""Transcript builders for the tests; all content is invented."""

from __future__ import annotations

import json


def stamp(second: float, minute: int = 0) -> str:
    return f"2026-03-01T10:{minute:02d}:{second:06.3f}Z" if second % 1 else f"2026-03-01T10:{minute:02d}:{int(second):02d}Z"


def user(text, at=0, **extra):
    return {"type": "user", "timestamp": stamp(at), "sessionId": "s-main", "cwd": "/work/garden", "gitBranch": "main",
            "message": {"role": "user", "content": text}, **extra}


def assistant(blocks, usage=None, at=1, mid="m1", rid="r1", model="oak-1", **extra):
    message = {"id": mid, "model": model, "content": blocks}
    if usage is not None:
        message["usage"] = usage
    return {"type": "assistant", "timestamp": stamp(at), "sessionId": "s-main", "cwd": "/work/garden", "requestId": rid,
            "message": message, **extra}


def tokens(inp=0, out=0, **extra):
    return {"input_tokens": inp, "output_tokens": out, **extra}


def text(value):
    return {"type": "text", "text": value}


def tool(call, tool_name, **fields):
    return {"type": "tool_use", "id": call, "name": tool_name, "input": fields}


def result(call, content, error=False):
    return {"type": "tool_result", "tool_use_id": call, "content": content, "is_error": error}


def item(line_type, at=0, **payload):
    return {"timestamp": stamp(at), "type": line_type, "payload": payload}


def counter(inp, out, cached=0, reasoning=0):
    return {"input_tokens": inp, "cached_input_tokens": cached, "output_tokens": out,
            "reasoning_output_tokens": reasoning, "total_tokens": inp + out}


def token_count(at, last=None, total=None):
    info = {}
    if last is not None:
        info["last_token_usage"] = last
    if total is not None:
        info["total_token_usage"] = total
    return item("event_msg", at, type="token_count", info=info)


def write(path, *records, end="\n", newline="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    body = newline.join(record if isinstance(record, str) else json.dumps(record, ensure_ascii=False) for record in records)
    path.write_bytes((body + end).encode())
    return path
