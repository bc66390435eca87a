"""Scalar text functions, all as JVM-side column expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TIMELINE_NOISE_TAGS = ["system-reminder", "permission-preamble", "local-command-caveat"]
PREAMBLE_TAGS = ["recommended_plugins", "instructions", "environment_context"]
AUTONOMOUS_PREAMBLE = "you are an autonomous implementation agent"
REVIEWER_PREAMBLE = "you are an independent, cross-model reviewer"
INSTRUCTIONS_PREAMBLE = "agents.md instructions"
BOILERPLATE_TITLES = ["task", "requirements", "available plugins"]
BOILERPLATE_PREFIXES = [
    INSTRUCTIONS_PREAMBLE,
    AUTONOMOUS_PREAMBLE,
    REVIEWER_PREAMBLE,
    "deliver the complete implementation",
    "work from the task below",
    "you receive no conversation history",
    "the orchestrator accepts or rejects",
    "here is a list of plugins",
    "before the first substantive task",
]
TITLE_CODE_POINTS = 96
DETAIL_CODE_POINTS = 4096
ENCRYPTED_MIN_CHARS = 64

# White space, without and with the line feed, as character classes and spelled out.
_BLANK = r"\p{IsWhite_Space}&&[^\n]"
_SPACE = r"\p{IsWhite_Space}"
_SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_CIPHER = r"(?<![A-Za-z0-9_-])gAAAA[A-Za-z0-9_-]*+=*+"


def _sub(column: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(column, F.lit(pattern), F.lit(replacement))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(column: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(column, F.lit(_SPACES))


def collapse(column: Column) -> Column:
    """White-space runs become one space, ends trimmed."""
    return F.trim(_sub(column, rf"[{_SPACE}]++", " "))


def clean_timeline_text(column: Column) -> Column:
    """Remove harness tag blocks and warmup lines, then normalise blank lines.

    One left-to-right pass removes the blocks: a block that owns its line goes with its newline,
    an unclosed block goes to the end of the text.
    """
    tags = "|".join(TIMELINE_NOISE_TAGS)
    owned = rf"(?:\A|(?<=\n))(?>(?:[ \t]*+<({tags})(?>.*?</\1>))++)\n"
    other = rf"<({tags})(?:(?>.*?</\2>)|.*\z)"
    text = _sub(column, f"(?is){owned}|{other}")
    text = _sub(text, rf"(?dm)(?<![{_BLANK}])[{_BLANK}]++$")
    text = _sub(text, rf"(?dim)^[{_BLANK}]*+warmup(?:\n|\z)")
    text = _sub(text, r"\n{3,}", "\n\n")
    return _sub(text, r"\A\n++|(?<!\n)\n++\z")


def _clean_title_line(line: Column) -> Column:
    text = _sub(strip(line), rf"\A(?:<[^>]*+>[{_SPACE}]*+)++")
    text = _sub(text, r"</[^>]*+>")
    text = _sub(text, rf"\A[{_SPACE}#>*-]++")

    def capped(title: Column) -> Column:
        cut = F.concat(F.substring(title, 1, TITLE_CODE_POINTS - 1), F.lit("…"))
        return F.when(F.char_length(title) > TITLE_CODE_POINTS, cut).otherwise(strip(title))

    return bind(text, capped)


def title_lines(column: Column) -> Column:
    """Every line of the text as a cleaned title, empty ones dropped, order kept."""
    lines = F.transform(F.split(column, "\n"), _clean_title_line)
    return F.filter(lines, lambda line: line != "")


def clean_title(column: Column) -> Column:
    """First line with content, without leading markup, at most 96 code points."""
    rest = F.coalesce(F.get(title_lines(column), F.lit(0)), F.lit(""))
    # The first line nearly always decides; the others are looked at only where it is empty.
    first = _clean_title_line(F.substring_index(column, "\n", 1))
    return bind(first, lambda title: F.when(title != "", title).otherwise(rest))


def elide_encrypted(column: Column) -> Column:
    """Replace long encrypted tokens by a note of their length."""

    def shown(token: Column) -> Column:
        size = F.char_length(token)
        note = F.concat(F.lit("<encrypted "), size.cast("string"), F.lit(" chars>"))
        return F.when(size >= ENCRYPTED_MIN_CHARS, note).otherwise(token)

    def elided(text: Column) -> Column:
        parts = F.split(text, _CIPHER, -1)
        tokens = F.regexp_extract_all(text, F.lit(_CIPHER), F.lit(0))
        woven = F.zip_with(parts, tokens, lambda part, token: F.concat(part, F.coalesce(shown(token), F.lit(""))))
        return F.when(F.contains(text, F.lit("gAAAA")), F.array_join(woven, "")).otherwise(text)

    return bind(column, elided)


def bounded_text(column: Column, limit: int | Column = DETAIL_CODE_POINTS) -> Column:
    """Keep the head and tail of a long text around an ellipsis; a number of 0 keeps all."""
    if isinstance(limit, Column):
        head = F.floor((limit - 1) / 2).cast("int")
        kept = F.concat(F.left(column, head), F.lit("…"), F.right(column, limit - 1 - head))
        return F.when(F.char_length(column) > limit, kept).otherwise(column)
    if limit <= 0:
        return column
    head = (limit - 1) // 2
    tail = limit - 1 - head
    kept_tail = F.right(column, F.lit(tail)) if tail else F.lit("")
    return F.when(
        F.char_length(column) > limit, F.concat(F.left(column, F.lit(head)), F.lit("…"), kept_tail)
    ).otherwise(column)


def is_cut(column: Column, limit: int | Column) -> Column:
    return F.lit(False) if not isinstance(limit, Column) and limit <= 0 else F.char_length(column) > limit


def terminal_safe(column: Column) -> Column:
    """Control and format characters become spaces, white space collapses."""
    return collapse(_sub(column, r"[\p{Cc}\p{Cf}]", " "))


def basename(column: Column) -> Column:
    """Last path segment; '.' for an empty path, '/' for a path of separators only."""
    trimmed = F.regexp_replace(column, "/+$", "")
    return (
        F.when(column == "", F.lit("."))
        .when(trimmed == "", F.lit("/"))
        .otherwise(F.substring_index(trimmed, "/", -1))
    )


def short_model(column: Column) -> Column:
    """Display name of a model: vendor prefix and variant suffix removed."""
    text = _sub(_sub(column, r"\Aclaude-"), r"-sol\z")
    return _sub(text, r"-4-8\z", "-4.8")


def short_text_lines(column: Column) -> Column:
    """Number of lines of a text; 0 for the empty text."""
    newlines = F.char_length(column) - F.char_length(F.replace(column, F.lit("\n"), F.lit("")))
    return F.when(column == "", F.lit(0)).otherwise(newlines + 1)


def prefixed_lines(column: Column, prefix: str) -> Column:
    """Put ``prefix`` before every line."""
    return F.concat(F.lit(prefix), F.replace(column, F.lit("\n"), F.lit("\n" + prefix)))


def replace_block(old: Column, new: Column) -> Column:
    """A whole-block diff: every old line removed, every new line added."""
    removed = F.when(old != "", prefixed_lines(old, "-"))
    added = F.when(new != "", prefixed_lines(new, "+"))
    return F.concat_ws("\n", removed, added)


def prompt_task_text(column: Column) -> Column:
    """The task of a prompt: injected preambles removed, empty when nothing but preamble is left.

    A preamble is a closed tag block, an instructions heading line, or an agent role text that
    ends at a ``---`` line.
    """
    tags = "|".join(PREAMBLE_TAGS)
    lead = rf"(?:<[^>\n]*+>[{_BLANK}]*+)*+[{_SPACE}#>*\-&&[^\n]]*+"
    roles = f"(?:{AUTONOMOUS_PREAMBLE}|{REVIEWER_PREAMBLE})"
    block = rf"<({tags})(?>.*?</\1>)"
    role = rf"{lead}{roles}(?>.*?\n[{_BLANK}]*+---[{_BLANK}]*+(?:\n|\z))"
    heading = rf"{lead}{INSTRUCTIONS_PREAMBLE}[^\n]*+(?:\n|\z)"
    rest = strip(_sub(column, rf"(?is)\A(?:[{_SPACE}]*+(?:{block}|{role}|{heading}))++"))
    dangling = rf"(?is)\A(?:<(?:{tags})|{lead}{roles})"
    return bind(rest, lambda task: F.when(F.rlike(task, F.lit(dangling)), F.lit("")).otherwise(task))


def _is_boilerplate(title: Column) -> Column:
    low = F.lower(title)
    return (title == "") | low.isin(BOILERPLATE_TITLES) | F.rlike(low, F.lit(rf"\A(?:{'|'.join(BOILERPLATE_PREFIXES)})"))


def task_title(column: Column) -> Column:
    """Title of a task prompt: a ``Brief`` heading, else the first line that is not boilerplate."""
    text = bind(prompt_task_text(column), lambda task: F.when(task == "", column).otherwise(task))
    tags = "|".join(PREAMBLE_TAGS)
    text = _sub(text, rf"(?is)(?:\A|(?<=\n))[{_BLANK}]*+<({tags})(?>.*?(?:</\1>|\z))[^\n]*+")

    # A heading stands for its words; a line of hashes only stays as it is.
    def worded(line: Column) -> Column:
        is_heading = F.startswith(line, F.lit("#"))
        bare = strip(_sub(line, r"\A#++"))
        words = bind(bare, lambda heading: F.when(is_heading & (heading != ""), heading).otherwise(line))
        return F.struct(is_heading.alias("is_heading"), words.alias("words"))

    def titled(body: Column) -> Column:
        lines = F.transform(F.transform(F.split(body, "\n"), strip), worded)
        briefs = F.filter(lines, lambda line: line["is_heading"] & F.startswith(F.lower(line["words"]), F.lit("brief")))
        briefs = F.transform(briefs, lambda line: _clean_title_line(_sub(F.substr(line["words"], F.lit(6)), r"\A[ —:-]++")))
        brief = F.get(F.filter(briefs, lambda title: title != ""), F.lit(0))
        has_brief = F.rlike(body, F.lit(rf"(?dim)^[{_BLANK}]*+#++[{_BLANK}]*+brief"))
        plain = F.filter(F.transform(lines, lambda line: _clean_title_line(line["words"])), lambda title: ~_is_boilerplate(title))
        head = _clean_title_line(worded(strip(F.substring_index(body, "\n", 1)))["words"])
        first = bind(head, lambda title: F.when(_is_boilerplate(title), F.get(plain, F.lit(0))).otherwise(title))
        return F.coalesce(F.when(has_brief, brief), first, F.lit(""))

    return bind(text, titled)


# Quoted strings and comments of a wrapper script.
_SCRIPT_NOISE = (
    r"(?s)'[^'\\]*+(?:\\.[^'\\]*+)*+(?:'|\z)"
    r'|"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\z)'
    r"|`[^`\\]*+(?:\\.[^`\\]*+)*+(?:`|\z)"
    r"|//[^\n]*+|/\*.*?(?:\*/|\z)"
)
_SCRIPT_CALL = r"(?<![A-Za-z0-9_$\p{L}\p{Nd}\p{M}\x{200C}\x{200D}])tools\.([A-Za-z0-9_$]{1,96})\("


def nested_tools(script: Column) -> Column:
    """Names of the ``tools.x(`` calls of a wrapper script, outside strings and comments."""
    return F.regexp_extract_all(_sub(script, _SCRIPT_NOISE, " "), F.lit(_SCRIPT_CALL), F.lit(1))


def patch_files(patch: Column) -> Column:
    """Distinct base names of the files a patch touches, first seen first."""
    pattern = rf"(?dm)^[{_BLANK}]*+\*\*\* (?:Update|Add|Delete) File: ([^\n]*+)$"
    names = F.transform(F.regexp_extract_all(patch, F.lit(pattern), F.lit(1)), lambda raw: basename(strip(raw)))
    return F.array_distinct(F.filter(names, lambda name: ~name.isin("", ".", "/")))


def patch_line_counts(patch: Column) -> tuple[Column, Column]:
    """Added and removed lines of a patch, file headers excluded."""
    added = F.regexp_count(patch, F.lit(r"(?dm)^\+(?!\+\+)"))
    removed = F.regexp_count(patch, F.lit(r"(?dm)^-(?!--)"))
    return added, removed


def exit_summary(text: Column, marker: str) -> Column:
    """``exit N`` after the first ``marker``, or null when the marker is absent."""
    found = F.regexp_extract(text, rf"(?s)\A.*?{marker}([^ \r\n]*+)", 1)
    return F.when(F.contains(text, F.lit(marker)), F.concat(F.lit("exit "), found))


def split_exec_preamble(output: Column) -> tuple[Column, Column]:
    """Body and exit code of a shell result with a status header; the exit code may be null."""
    pad = rf"[{_BLANK}]*+"
    exit_line = rf"{pad}Process exited with code ([+]?[0-9]+){pad}"
    state_line = rf"{pad}Script (?:completed|running with cell ID [^ \t\r\n]{{1,256}}){pad}"
    wall = rf"{pad}Wall time [+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)? seconds{pad}\n"
    label = rf"{pad}(?:Output:|Final output:){pad}(?:\n|\z)"
    code = F.regexp_extract(output, rf"\A{exit_line}(?:\n|\z)", 1)
    with_wall = rf"\A(?:{exit_line}|{state_line})\n{wall}{label}"
    no_wall = rf"\A{exit_line}\n{label}"
    body = F.when(
        F.rlike(output, F.lit(with_wall)), strip(_sub(output, with_wall))
    ).when(F.rlike(output, F.lit(no_wall)), strip(_sub(output, no_wall)))
    return F.coalesce(body, output), F.when(code != "", code)
