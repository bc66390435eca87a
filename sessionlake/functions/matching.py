"""Pattern matching with code-point ranges, counts and snippets."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Constructs of the JVM dialect that the linear-time dialect of the search language lacks.
_UNSUPPORTED = re.compile(
    r"\(\?(?:[=!>]|<[=!])"  # look-around, atomic groups
    r"|(?<!\\)(?:\\\\)*\\[1-9k]"  # back references
    r"|(?<!\\)(?:\\\\)*[*+?}]\+"  # possessive quantifiers
)


_LINE_MODE = re.compile(r"\(\?[a-z]*m")
_TOKEN = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\$", re.S)
_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_NO_BOUNDARY = r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"


def _jvm_spelling(pattern: str) -> str:
    """The same expression for the JVM: ASCII word boundaries, and ``$`` as the end of the text.

    In line mode ``$`` keeps its meaning.
    """
    swaps = {r"\b": _BOUNDARY, r"\B": _NO_BOUNDARY}
    if not _LINE_MODE.search(pattern):
        swaps["$"] = r"\z"
    return _TOKEN.sub(lambda token: swaps.get(token[0], token[0]), pattern)


@dataclass(frozen=True)
class Matcher:
    """A compiled search pattern, ready to be applied to text columns."""

    pattern: str
    may_be_empty: bool = False

    def hits(self, text: Column) -> Column:
        return F.rlike(text, F.lit(self.pattern))

    def count(self, text: Column) -> Column:
        """Non-overlapping matches; an empty one never touches the match before it."""
        if not self.may_be_empty:
            return F.regexp_count(text, F.lit(self.pattern))
        fresh = rf"(?:(?!\G)|\A){self.pattern}"
        touching = rf"\G(?>{self.pattern})(?!\G)"
        return F.regexp_count(text, F.lit(rf"(?!\p{{Cs}})(?:{fresh}|{touching})"))

    def span(self, text: Column) -> tuple[Column, Column]:
        """Half-open code-point range of the first match; only meaningful where ``hits``."""
        framed = rf"(?s:\A(.*?))({self.pattern})"
        start = F.char_length(F.regexp_extract(text, framed, 1))
        return start, start + F.char_length(F.regexp_extract(text, framed, 2))


def compile_matcher(pattern: str, regex: bool = False, case_sensitive: bool = False) -> Matcher:
    """Literal or regular-expression matcher.

    A case-insensitive ASCII literal folds ASCII only; any other literal folds by Unicode rules.
    """
    if pattern == "":
        raise ValueError("nothing to search for")
    if regex:
        if _UNSUPPORTED.search(pattern):
            raise ValueError(f"unsupported construct in regular expression {pattern!r}")
        flags = "d" if case_sensitive else "diu"
        return Matcher(f"(?{flags}:{_jvm_spelling(pattern)})", may_be_empty=True)
    quoted = r"\Q" + pattern.replace(r"\E", r"\E\\E\Q") + r"\E"
    if case_sensitive:
        return Matcher(f"(?:{quoted})")
    return Matcher(f"(?i:{quoted})" if pattern.isascii() else f"(?iu:{quoted})")


def snippet(text: Column, start: Column, end: Column, around: int) -> Column:
    """The match with ``around`` code points either side, an ellipsis where text was cut."""
    size = F.char_length(text)
    around = min(around, 1 << 30)
    first = F.greatest(F.lit(0), start - around)
    last = F.least(size, F.when(end > size - around, size).otherwise(end + around))
    return F.concat(
        F.when(first > 0, F.lit("…")).otherwise(F.lit("")),
        F.substring(text, first + 1, last - first),
        F.when(last < size, F.lit("…")).otherwise(F.lit("")),
    )


def fuzzy_pattern(query: str) -> str:
    """Lower-cased in-order subsequence pattern of a query.

    Every step runs possessively to the next wanted character, so a text is read once and never again.
    """
    wanted = query.strip().lower()
    spelled = [re.escape(char) if char.isascii() and not char.isalnum() else char for char in wanted]
    return r"\A" + "".join(f"[^{char}]*+{char}" for char in spelled)
