"""Scalar text expressions: clipping, snippets, query terms, regex literals, model names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(text: Column, size: int = 80) -> Column:
    """White space collapsed, at most `size` characters, an ellipsis where it was longer."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("…"))).otherwise(flat)


def bounded(text: Column, size: int) -> tuple[Column, Column]:
    """(first `size` characters, whether there were more)."""
    return F.substring(text, 1, size), F.length(text) > size


def contains(text: Column, term: str) -> Column:
    return F.contains(F.lower(text), F.lit(term.lower()))


def snippet(text: Column, term: str, before: int = 120, after: int = 240) -> Column:
    """The surroundings of the first hit with an ellipsis at each cut end; without a hit the first `after` characters."""
    at = F.locate(term.lower(), F.lower(text))
    lo = F.greatest(F.lit(1), at - before)
    hi = F.least(F.length(text), at + len(term) - 1 + after)
    cut = F.concat(
        F.when(lo > 1, "…").otherwise(""), text.substr(lo, hi - lo + 1), F.when(hi < F.length(text), "…").otherwise("")
    )
    return F.when(at > 0, cut).otherwise(F.substring(text, 1, after))


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of `term`, case folded."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(term.lower()), F.lit("")))) / len(term)).cast("long")


def query_terms(query: str) -> list[str]:
    """Quoted phrases and words; bare OR, AND and NOT are not terms."""
    found = re.findall(r'"([^"]+)"|(\S+)', query)
    words = [phrase or word for phrase, word in found]
    return [
        w.lower() for w,
        (phrase, _) in zip(words, found, strict=True) if phrase or w.upper() not in ("OR", "AND", "NOT")
    ]


#: What the prefilter reads: escapes of signs and of the classes and anchors both dialects share, a class of plain
#: characters, a repeat count, any other single character. `]` may not start a class, `[` and `\` not lie in one.
_PIECE = re.compile(r"\\[dDwWsSbBtnrf]|\\[^0-9A-Za-z]|\[\^?[^\[\]\\^][^\[\]\\]*\]|\{\d*,?\d*\}|[^\\\[{]", re.DOTALL)


def required_literals(pattern: str, least: int = 3) -> list[str]:
    """Literal runs that every match of `pattern` holds: those outside groups, classes, options and alternatives.
    None where the pattern holds anything that is not surely read: other escapes, classes with an escape or a nested
    bracket, comments, flags that fold case or skip white space."""
    if re.search(r"\(\?(#|[a-zA-Z-]*[ix])", pattern):
        return []
    pieces, at = [], 0
    while at < len(pattern):
        if (piece := _PIECE.match(pattern, at)) is None:
            return []
        pieces.append(piece[0])
        at = piece.end()
    if "|" in pieces:
        return []
    out, run, depth = [], "", 0

    def close() -> None:
        nonlocal run
        if len(run) >= least and not depth:
            out.append(run)
        run = ""

    for piece, follow in zip(pieces, [*pieces[1:], ""], strict=True):
        literal = piece[-1] if len(piece) == 1 and piece not in ".^$*+?}]()" or len(piece) == 2 and not piece[1].isalnum() else ""
        if literal and follow[:1] not in ("*", "?", "{"):
            run += literal
            if follow == "+":
                close()
        else:
            close()
        if piece == "(":
            depth += 1
        elif piece == ")":
            depth -= 1
    close()
    return out


#: What both dialects read alike: plain ASCII characters but for the signs below, escaped ASCII signs, the escapes of
#: control characters, classes of ASCII letters, digits and plain signs, counts and groups. Not in it: classes such as
#: \\w, \\d, \\s and \\b (Unicode in one dialect), `.` and `$` (line ends differ), classes within classes.
_ALIKE = re.compile(
    r"(?:[A-Za-z0-9 _@#%&=:;,<>/~!'\"`-]|\\[.^$*+?{}\[\]()|\\/-]|\\[tnr]|\[\^?(?:[A-Za-z0-9]-[A-Za-z0-9]|[A-Za-z0-9 _.,:;@#%=<>/!'\"+*?()]|\\[\]\[^\\-])+\]"
    r"|\((?:\?[:=!])?(?!\?)|\)|[|*+?]|\{\d+(?:,\d*)?\}|\^)*"
)


def java_regex(pattern: str) -> str | None:
    """The pattern for `rlike` where both dialects surely read it alike; None where it needs a Python function."""
    return pattern if _ALIKE.fullmatch(pattern) else None


def model_key(model: Column) -> Column:
    """Last path part of a model name, lower case."""
    return F.lower(F.element_at(F.split(model, "/"), -1))


def project_name(path: Column) -> Column:
    """Last part of a directory that is not empty."""
    return F.element_at(F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda x: x != ""), -1)
