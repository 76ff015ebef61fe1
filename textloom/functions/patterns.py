"""Regular expressions of the linear-time dialect, and globs, in the dialects that run them.

Queries are written for a dialect without look-around and back-references, where `$` is the very end, `.` is all but a
newline, and classes are ASCII. The same pattern is turned into one for the JVM and one for Python.
"""

from __future__ import annotations

import re
from functools import cache

#: Named classes, and escapes whose meaning differs between dialects.
_CLASSES = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_SPACE = r"\t\n\f\r "
#: Borders of ASCII words, which the JVM's own escapes don't stand for.
_W = "[0-9A-Za-z_]"
_BORDER, _NO_BORDER = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))", rf"(?:(?<={_W})(?={_W})|(?<!{_W})(?!{_W}))"


def _parts(pattern: str) -> list[str]:
    """Escapes, named classes, class borders, group openings and single characters."""
    return re.findall(r"\\Q.*?(?:\\E|\Z)|\\[pP]\{[^}]*\}|\\x\{[^}]*\}|\\.|\[:\^?\w+:\]|\(\?[^)]?|.", pattern, re.DOTALL)


def _translated(pattern: str, java: bool) -> str | None:
    out, inside, multiline = [], False, bool(re.match(r"\(\?[a-z]*m", pattern))
    parts = _parts(pattern)
    i = 0
    while i < len(parts):
        p = parts[i]
        if p.startswith("\\Q"):
            out.append(re.escape(p[2:].removesuffix("\\E")))
        elif p.startswith("[:") and inside:
            name = p[2:-2]
            kind = _CLASSES.get(name.lstrip("^"))
            if kind is None or (name.startswith("^") and not java):
                return None
            out.append(f"[^{kind}]" if name.startswith("^") else kind)
        elif p.startswith("\\"):
            c = p[1:2]
            if not c or c in "123456789kC" or (c in "GKRXN" and not inside):
                return None
            if c == "s":
                out.append(_SPACE if inside else f"[{_SPACE}]")
            elif c == "S" and not inside:
                out.append(f"[^{_SPACE}]")
            elif c in "bB" and java and not inside:
                out.append(_BORDER if c == "b" else _NO_BORDER)
            elif c == "z":
                out.append(r"\z" if java else r"\Z")
            elif c == "Z":
                return None
            elif c in "pP" and not java:
                return None
            elif c == "x" and not java and p.startswith("\\x{"):
                out.append(re.escape(chr(int(p[3:-1], 16))))
            else:
                out.append(p)
        elif p == "[" and not inside:
            inside = True
            out.append(p)
            if i + 1 < len(parts) and parts[i + 1] == "^":
                out.append("^")
                i += 1
            if i + 1 < len(parts) and parts[i + 1] == "]":
                out.append(r"\]")
                i += 1
        elif p == "]" and inside:
            inside = False
            out.append(p)
        elif p == "[" and inside:
            out.append(r"\[")
        elif p == "&" and inside:
            out.append(r"\&")
        elif p == "$" and not inside and not multiline:
            out.append(r"\z" if java else r"\Z")
        elif p.startswith("(?") and not inside:
            if p in ("(?=", "(?!", "(?>", "(?#", "(?("):
                return None
            if p == "(?P" and java:
                out.append("(?")
            elif p == "(?<" and i + 1 < len(parts) and parts[i + 1] in "=!":
                return None
            else:
                out.append("(?P<" if p == "(?<" and not java else p)
        elif p in "+*?" and not inside and out and out[-1] in ("+", "*", "?") and p in "+*":
            return None
        else:
            out.append(p)
        i += 1
    return None if inside else "".join(out)


@cache
def python_regex(pattern: str) -> re.Pattern[str] | None:
    """For Python, or None if the pattern isn't valid: then it matches nothing."""
    made = _translated(pattern, java=False)
    try:
        return None if made is None else re.compile(made, re.ASCII)
    except (re.error, OverflowError, RecursionError):
        return None


@cache
def java_regex(pattern: str) -> str | None:
    """For the JVM, or None if the pattern isn't valid."""
    made = _translated(pattern, java=True)
    if made is None or (python_regex(pattern) is None and not re.search(r"\\[pP]|\[:\^", pattern)):
        return None
    return "(?d)" + made


def glob_regex(pattern: str) -> str | None:
    """A glob of one path segment as a regular expression for the whole of it, or None if it is malformed.

    `*` and `?` don't cross a slash; classes negate with `^`; a backslash takes the next character as it is.
    """
    out, i = [], 0
    quoted = re.escape
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i == len(pattern):
                return None
            out.append(quoted(pattern[i]))
            i += 1
        elif c == "[":
            negated = pattern[i : i + 1] == "^"
            i += negated
            items: list[str] = []
            while pattern[i : i + 1] != "]" or not items:
                ends = []
                while True:
                    if i >= len(pattern) or pattern[i] in "-]":
                        return None
                    if pattern[i] == "\\":
                        i += 1
                        if i == len(pattern):
                            return None
                    ends.append(pattern[i])
                    i += 1
                    if len(ends) == 2 or pattern[i : i + 1] != "-":
                        break
                    i += 1
                if i >= len(pattern):
                    return None
                if len(ends) == 1 or ends[0] <= ends[1]:
                    items.append("-".join("\\" + e if e in "\\]^[&-" else e for e in ends))
                else:
                    items.append("")
            i += 1
            body = "".join(items)
            if body:
                out.append(f"[{'^' if negated else ''}{body}]")
            else:
                out.append("[^/]" if negated else "(?!)")
        else:
            out.append(quoted(c))
    return "".join(out)


def path_glob_regex(pattern: str) -> str | None:
    """A glob of one or more segments, as a regular expression to be found in a path at any run of segments."""
    made = [glob_regex(s) for s in pattern.split("/")]
    return None if None in made else r"(?:^|/)" + "/".join(made) + r"(?:\z|/)"


def has_glob(pattern: str) -> bool:
    return any(c in pattern for c in "*?[")
