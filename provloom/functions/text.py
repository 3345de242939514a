"""Spans, globs, versions and scans of text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = r"^(.+):(\d+)-(\d+)$"
#: Texts that must not reach an artifact.
LEAKS = {"timestamp": r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z", "absolute_path": r"(^|\s)/[\w/.-]+", "backslash": r"\\"}
#: Words that no statement may contain.
BANNED_WORDS = ["is vulnerable", "vulnerable", "exploit", "severity", "critical", "finding", "attack", "poc", "confirmed"]


def span_text(file: Column, start: Column, end: Column) -> Column:
    return F.concat(file, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def span_parts(span: Column) -> Column:
    """struct(file, line_start, line_end), null where the text is no span."""
    part = lambda k: F.regexp_extract(span, SPAN, k)
    return F.when(span.rlike(SPAN), F.struct(part(1).alias("file"), part(2).cast("int").alias("line_start"), part(3).cast("int").alias("line_end")))


def line_at(text: Column, offset: Column) -> Column:
    """The line (from 1) that holds the byte at ``offset``."""
    before = F.substr(F.encode(text, "UTF-8"), F.lit(1), offset.cast("int"))
    return (F.length(F.hex(before)) / 2 - F.length(F.replace(F.decode(before, "ISO-8859-1"), F.lit("\n"), F.lit(""))) + 1).cast("long")


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` within one."""
    tokens = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(tokens.get(t) or re.escape(t) for t in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]", glob)) + "$"


def first_match(path: Column, globs: list[str], prefix: str = "") -> Column:
    """The first glob of the list that the path fits, with ``prefix``; else null."""
    return F.coalesce(*[F.when(path.rlike(glob_pattern(g)), F.lit(prefix + g)) for g in globs]) if globs else F.lit(None).cast("string")


def version_parts(version: Column) -> Column:
    """struct(major, minor, patch) that compares as versions do; null for other texts."""
    shape = r"^(\d+)\.(\d+)\.(\d+)$"
    names = ("major", "minor", "patch")
    return F.when(F.trim(version).rlike(shape), F.struct(*[F.regexp_extract(F.trim(version), shape, k + 1).cast("int").alias(n) for k, n in enumerate(names)]))


def satisfies(version: Column, ranges: str) -> Column:
    """Whether a version fits a range text: ``||`` alternatives of ``^ >= <= > < =`` terms."""
    found = F.lit(False)
    for group in ranges.split("||"):
        terms = [t for t in group.split() if t != "&&"]
        if terms:
            fits = F.lit(True)
            for term in terms:
                fits = fits & _term(version_parts(version), term)
            found = found | fits
    return F.coalesce(found, F.lit(False))


def _term(parts: Column, term: str) -> Column:
    match = re.fullmatch(r"(\^|>=|<=|>|<|=)?(\d+)\.(\d+)\.(\d+)", term)
    if not match:
        return F.lit(False)
    target = tuple(map(int, match.groups()[1:]))
    lit = lambda v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("major", "minor", "patch"))])
    operator = match[1] or "="
    if operator == "^":
        major, minor, patch = target
        above = (major + 1, 0, 0) if major else (0, minor + 1, 0) if minor else (0, 0, patch + 1)
        return (parts >= lit(target)) & (parts < lit(above))
    return {"=": parts == lit(target), ">": parts > lit(target), ">=": parts >= lit(target), "<": parts < lit(target), "<=": parts <= lit(target)}[operator]


def pragma_ranges(text: Column, word: str = "solidity") -> Column:
    """Every version range that a text's pragmas name."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"\bpragma\s+{word}\s+([^;]+);"), F.lit(1)), lambda x: F.trim(x))


def leaks(text: Column, kind: str) -> Column:
    return text.rlike(LEAKS[kind])


def holds_word(text: Column, words: list[str]) -> Column:
    return F.lower(text).rlike("|".join(map(re.escape, words)))


def modifier_text(name: Column, arguments: Column) -> Column:
    """``name(arguments)`` with runs of white space as one space; the name alone without arguments."""
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.coalesce(squeezed(arguments), F.lit("")) == "", squeezed(name)).otherwise(F.concat(squeezed(name), F.lit("("), squeezed(arguments), F.lit(")")))


def literal_path(pattern: Column) -> Column:
    """A literal include as a root-relative path; null for globs and for paths that leave the root."""
    plain = F.regexp_replace(F.translate(pattern, "\\", "/"), r"^(\./)+", "")
    leaves = plain.rlike(r"^/|(^|/)\.\.(/|$)") | (plain == "")
    return F.when(~plain.rlike(r"[*?]") & ~leaves, plain)


def long_version(build_path: Column) -> Column:
    """The version that a compiler's build path names: ``…-v1.2.3+commit.abc.js`` gives ``1.2.3+commit.abc``."""
    found = F.regexp_extract(build_path, r"-v(\d+\.\d+\.\d+\+commit\.[0-9a-f]+)(?:\.js)?$", 1)
    return F.when(found != "", found)


def known_or_unknown(value: Column, known: list[str]) -> Column:
    return F.when(value.isin(known), value).otherwise("unknown")


def iso_millis(timestamp: Column) -> Column:
    """A timestamp as ``YYYY-MM-DDTHH:MM:SS.mmmZ`` in UTC."""
    return F.date_format(F.to_utc_timestamp(timestamp, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def safe_path(path: Column) -> Column:
    """Whether a path is relative, without backslash, and stays below its root."""
    return (path != "") & ~path.rlike(r"^/|\\|(^|/)\.\.(/|$)")
