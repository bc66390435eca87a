"""Scalar text functions and matchers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sessionlake.functions import matching, refs
from sessionlake.functions import text as T


def apply(spark, function, value):
    return spark.createDataFrame([(value,)], "t string").select(function(F.col("t")).alias("o")).first().o


CIPHER = "gAAAA" + "b" * 70


@pytest.mark.parametrize(
    "function, value, want",
    [
        (T.clean_timeline_text, "a\n<system-reminder>z\nq</system-reminder>\nb", "a\nb"),
        (T.clean_timeline_text, "x <system-reminder>a</system-reminder> mid <system-reminder>b</system-reminder>\nz", "x  mid\nz"),
        (T.clean_timeline_text, "x\n<system-reminder>a</system-reminder><System-Reminder>b</system-reminder>\ny", "x\ny"),
        (T.clean_timeline_text, "hi <permission-preamble> never closed\nend", "hi"),
        (T.clean_timeline_text, "\n\n  code\n\n\n\nend  \n Warmup \n", "  code\n\nend"),
        (T.clean_title, "\n  <b> <i>## Hello</b> world  ", "Hello world"),
        (T.clean_title, "> - * # q\nnext", "q"),
        (T.clean_title, "😀" * 97, "😀" * 95 + "…"),
        (T.clean_title, "---\n\nsecond", "second"),
        (T.elide_encrypted, f"a {CIPHER}== x{CIPHER} gAAAAshort", f"a <encrypted 77 chars> x{CIPHER} gAAAAshort"),
        (lambda c: T.bounded_text(c, 7), "a😀cdefgh9", "a😀c…gh9"),
        (lambda c: T.bounded_text(c, 1), "abc", "…"),
        (T.terminal_safe, "a\x1b[0m​ b\n\tc", "a [0m b c"),
        (T.basename, "/a/b/", "b"),
        (T.basename, "", "."),
        (T.short_model, "claude-oak-4-8", "oak-4.8"),
        (T.prompt_task_text, "<instructions>x</instructions>\n# AGENTS.md instructions for /x\nreal\nmore", "real\nmore"),
        (T.prompt_task_text, "<environment_context> open", ""),
        (T.prompt_task_text, "You are an autonomous implementation agent.\nfoo\n ---\nDo it", "Do it"),
        (T.prompt_task_text, "You are an autonomous implementation agent.\nfoo", ""),
        (T.task_title, "# Task\n\n## Brief — Fix it\nfoo", "Fix it"),
        (T.task_title, "Deliver the complete implementation\n# Real title", "Real title"),
        (lambda c: F.array_join(T.nested_tools(c), ","), "tools.a(1); 'tools.b('; // tools.c(\n x.tools.d(2); mytools.e(3)", "a,d"),
        (lambda c: F.array_join(T.patch_files(c), ","), "*** Update File: a/b.py\n*** Add File: c.py\n*** Delete File: x/b.py", "b.py,c.py"),
        (lambda c: T.replace_block(F.lit("x\ny"), c), "z", "-x\n-y\n+z"),
        (refs.escape_path, "a b/c~d*é/$&+=:@;", "a%20b/c~d%2A%C3%A9/$&+=:@%3B"),
    ],
)
def test_scalars(spark, function, value, want):
    assert apply(spark, function, value) == want


@pytest.mark.parametrize(
    "pattern, options, value, want",
    [
        ("k", {}, "😀 aKbK", (True, 1, 3, 4)),
        ("é", {}, "xÉ", (True, 1, 1, 2)),
        ("aa", {"case_sensitive": True}, "aaaaa", (True, 2, 0, 2)),
        ("A", {"case_sensitive": True}, "a", (False, 0, 0, 0)),
        (r"a.c\E", {}, r"A.C\e", (True, 1, 0, 5)),
        ("x*", {"regex": True}, "xx", (True, 1, 0, 2)),
        ("x*", {"regex": True}, "a😀", (True, 3, 0, 0)),
        ("b$", {"regex": True}, "b\n", (False, 0, 0, 0)),
        (r"\bcat\b", {"regex": True}, "écat cat", (True, 2, 1, 4)),
        ("(?m)^b$", {"regex": True}, "a\nb\nb", (True, 2, 2, 3)),
    ],
)
def test_matchers(spark, pattern, options, value, want):
    matcher = matching.compile_matcher(pattern, **options)
    frame = spark.createDataFrame([(value,)], "t string")
    column = F.col("t")
    assert tuple(frame.select(matcher.hits(column), matcher.count(column), *matcher.span(column)).first()) == want


def test_large_text(spark):
    big = "<system-reminder>" + "<x\n" * 200_000 + "</system-reminder>\n" + "y" * 200_000
    assert len(apply(spark, T.clean_timeline_text, big)) == 200_000
    assert apply(spark, lambda c: F.size(T.nested_tools(c)), "'" + "\\'a" * 200_000 + "' tools.q(") == 1


@pytest.mark.parametrize("pattern", ["(?=a)", "a(?<!b)", r"(a)\1", "a++"])
def test_rejected_patterns(pattern):
    with pytest.raises(ValueError):
        matching.compile_matcher(pattern, regex=True)


def test_snippet(spark):
    assert apply(spark, lambda c: matching.snippet(c, F.lit(3), F.lit(5), 2), "01234567") == "…123456…"
    assert apply(spark, lambda c: matching.snippet(c, F.lit(0), F.lit(2), 9), "ab") == "ab"
