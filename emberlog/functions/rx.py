"""Patterns: users write RE2 syntax, Spark runs java.util.regex.

``java`` rewrites what differs: ``$`` is only the end of the text, ``.`` excludes only the line feed, ``\\s`` has no vertical tab,
``\\b`` looks at ASCII words, and case folding covers Unicode.  What RE2 does not have (lookaround, backreferences, possessive
quantifiers) is refused.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.errors import QueryError

_SPACE = r"\t\n\f\r "
_WORD = "[0-9A-Za-z_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_REFUSED = re.compile(r"\(\?(?:[=!>]|<[=!])|(?<!\\)(?:\\\\)*\\[1-9kG]|(?<!\\)[*+?}]\+")


def java(pattern: str, ignore_case: bool = False) -> str:
    """The Java form of an RE2 pattern; INVALID_REGEX for what is no RE2 pattern."""
    if _REFUSED.search(re.sub(r"\[\^?\]?(?:\\.|[^\]\\])*\]", "[x]", pattern)):
        raise QueryError("INVALID_REGEX", f"unsupported syntax in {pattern!r}")
    out, k, inside, first = [], 0, False, False
    while k < len(pattern):
        c = pattern[k]
        two = pattern[k : k + 2]
        if c == "\\" and k + 1 < len(pattern):
            swap = {r"\s": _SPACE if inside else f"[{_SPACE}]", r"\S": f"[^{_SPACE}]", r"\b": r"\b" if inside else _BOUNDARY, r"\z": r"\z"}
            out.append(swap.get(two, two))
            first = False
            k += 2
            continue
        if inside:
            if c == "]" and not first:
                inside = False
            out.append("\\" + c if c == "[" and not pattern.startswith("[:", k) or two == "&&" else c)
            first = first and c == "^"
        elif c == "[":
            inside, first = True, True
            out.append(c)
        elif pattern.startswith("(?P<", k):
            out.append("(?<")
            k += 4
            continue
        else:
            out.append(r"\z" if c == "$" else c)
        k += 1
    if inside:
        raise QueryError("INVALID_REGEX", f"missing closing ] in {pattern!r}")
    depth = re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", "x", pattern)
    if depth.count("(") != depth.count(")") or re.search(r"(?:^|[(|])[*+?]", depth.replace("(?", "(")):
        raise QueryError("INVALID_REGEX", f"unbalanced or misplaced operator in {pattern!r}")
    text = "".join(out).replace("(?i)", "(?iu)")
    return ("(?diu)" if ignore_case else "(?d)") + text


def matches(text: Column, pattern: str, regex: bool = True, case_sensitive: bool = False) -> Column:
    """Whether ``text`` has a match of the pattern, or of the literal, anywhere."""
    if regex:
        return text.rlike(java(pattern, ignore_case=not case_sensitive))
    return text.contains(pattern) if case_sensitive else F.lower(text).contains(pattern.lower())


def groups(text: Column, pattern: str, n: int) -> Column:
    """The ``n`` groups of a pattern that covers the whole text, as an array of strings; null without a match.

    The pattern runs once to test and once to split, however many groups there are.  Groups without a match are "".
    """
    form = java(pattern)
    clean = F.translate(text, "\x01", "")
    cut = F.split(F.regexp_replace(clean, form, "\x01".join(f"${k}" for k in range(1, n + 1))), "\x01", -1)
    return F.when(clean.rlike(form), cut)
