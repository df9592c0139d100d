"""Regex dialect (F9), severity shortcuts (P4) and line levels.

Patterns are written in the RE2 dialect (as users of the original tool write
them); Spark's ``rlike`` runs ``java.util.regex``.  ``to_java`` rewrites the
few constructs whose meaning differs and rejects what RE2 would refuse, so a
pattern means the same on both engines.  Translation happens once on the
driver; the executors only see a literal pattern inside ``rlike``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Severity shortcuts: words matched whole and in any case.
ERROR_WORDS = "error|err|fatal|panic|critical|severe|exception|traceback"
WARN_WORDS = "warn|warning"
SEVERITY_ALIASES = {
    "error": ERROR_WORDS,
    "errors": ERROR_WORDS,
    "warn": WARN_WORDS,
    "warning": WARN_WORDS,
    "warnings": WARN_WORDS,
}
# Line levels, checked in this order; the first hit names the level.
LEVEL_WORDS = (
    ("fatal", "fatal|panic|critical|severe|exception|traceback"),
    ("error", "error|err"),
    ("warn", "warn|warning"),
    ("info", "info"),
    ("debug", "debug|trace"),
)
NO_LEVEL = "none"
# POSIX classes inside brackets, RE2 meaning (ASCII) -> Java class.
POSIX_CLASSES = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}",
    "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}",
    "graph": r"\p{Graph}", "lower": r"\p{Lower}", "print": r"\p{Print}",
    "punct": r"\p{Punct}", "space": r"\p{Space}", "upper": r"\p{Upper}",
    "word": r"\w", "xdigit": r"\p{XDigit}",
}
# RE2's \\s has no vertical tab.
_SPACES = r"\t\n\f\r "
# Flags that RE2 knows, and one-letter or two-letter general categories of \\p; longer names are scripts.
_FLAGS = set("ims-")
# ASCII word boundary, as RE2 defines \b (Java 17's \b is Unicode-aware).
_WORD_BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
# the same boundary when the character after / before it is known to be a word character
_BOUNDARY_BEFORE_WORD = r"(?<![0-9A-Za-z_])"
_BOUNDARY_AFTER_WORD = r"(?![0-9A-Za-z_])"
_WORD_GROUP = re.compile(r"\((?:\?:)?[0-9A-Za-z_]+(?:\|[0-9A-Za-z_]+)*\)")
_NOT_WORD_BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))"
# -----------------------------------------------------------------------------


class UnsupportedPattern(ValueError):
    """The pattern uses a construct RE2 does not accept."""


def severity_pattern(s: str | None) -> str | None:
    """``error(s)`` / ``warn(ing)(s)`` in any case expand to word patterns."""
    if s is None:
        return None
    words = SEVERITY_ALIASES.get(s.lower())
    if words is None:
        return s
    return rf"(?i)\b({words})\b"


def to_java(pattern: str) -> str:
    """Rewrite an RE2 pattern into an equivalent ``java.util.regex`` pattern.

    * ``(?d)``: only ``\\n`` ends a line, so ``.`` and ``$`` treat ``\\r`` as
      RE2 does; ``(?u)``: case folding under ``(?i)`` is Unicode, as in RE2.
    * ``\\b``/``\\B`` become ASCII word boundaries; ``\\v`` is the single
      vertical-tab character; ``(?P<name>`` becomes ``(?<name>``.
    * ``[[:alpha:]]`` style classes are expanded (Java would read them as a
      nested class without complaint).
    * Look-around, back-references, possessive and atomic groups, ``\\Z``,
      ``\\C``, ``(?U)`` and flags that RE2 doesn't know are rejected, as RE2
      rejects them or means something else by them.
    * ``\\s`` is ``[\\t\\n\\f\\r ]``; ``\\p{Greek}`` and other scripts become
      ``\\p{IsGreek}``; ``{,n}`` is literal text.
    """
    out: list[str] = []
    i, n = 0, len(pattern)
    in_class = False
    class_start = False
    while i < n:
        c = pattern[i]
        if c == "\\":
            if i + 1 >= n:
                raise UnsupportedPattern("trailing backslash")
            d = pattern[i + 1]
            if d == "Q":  # quoted run, copied as is
                end = pattern.find("\\E", i + 2)
                end = n if end < 0 else end + 2
                out.append(pattern[i:end])
                i = end
                class_start = False
                continue
            if d.isdigit() and d != "0" and not in_class:
                raise UnsupportedPattern("back-references are not supported")
            if d in "ZCGkK" or (d == "h" or d == "H" or d == "R" or d == "X"):
                raise UnsupportedPattern(f"\\{d} is not supported")
            if d == "v":
                out.append("\\x0B")
            elif d == "s":
                out.append(_SPACES if in_class else f"[{_SPACES}]")
            elif d == "S":
                out.append(f"[^{_SPACES}]")  # inside a class this is a union
            elif d in "pP" and (name := re.match(r"\{(\^?)(\w{3,})\}", pattern[i + 2 :])):
                other = d if not name[1] else {"p": "P", "P": "p"}[d]
                out.append(f"\\{other}{{Is{name[2]}}}" if name[2] != "Any" else "[\\x{0}-\\x{10FFFF}]")
                i += name.end()
            elif d == "b" and not in_class:
                nxt = pattern[i + 2:i + 3]
                prv = "".join(out)[-1:] if out else ""
                grp = _WORD_GROUP.match(pattern, i + 2)
                follow = pattern[grp.end():grp.end() + 1] if grp else pattern[i + 3:i + 4]
                word_next = (nxt.isascii() and (nxt.isalnum() or nxt == "_")) or grp is not None
                if word_next and follow not in ("?", "*", "{"):
                    out.append(_BOUNDARY_BEFORE_WORD)
                elif prv and (prv.isalnum() and prv.isascii() and not _escaped_tail(out) or prv == "_"
                              or _ends_with_word_group(out)):
                    out.append(_BOUNDARY_AFTER_WORD)
                else:
                    out.append(_WORD_BOUNDARY)
            elif d == "B" and not in_class:
                out.append(_NOT_WORD_BOUNDARY)
            else:
                out.append(c + d)
            i += 2
            class_start = False
            continue
        if in_class:
            if c == "[" and pattern.startswith("[:", i):
                end = pattern.find(":]", i + 2)
                if end > 0:
                    name = pattern[i + 2:end]
                    neg = name.startswith("^")
                    name = name.lstrip("^")
                    if name not in POSIX_CLASSES:
                        raise UnsupportedPattern(f"unknown class [:{name}:]")
                    cls = POSIX_CLASSES[name]
                    if neg:
                        cls = r"\W" if cls == r"\w" else cls.replace(r"\p", r"\P")
                    out.append(cls)
                    i = end + 2
                    class_start = False
                    continue
            if c == "[":
                out.append("\\[")  # RE2 has no nested classes
                i += 1
                continue
            if c == "]" and not class_start:
                in_class = False
            elif c == "&" and pattern.startswith("&&", i):
                out.append("&\\&")  # Java class intersection; literal in RE2
                i += 2
                class_start = False
                continue
            out.append(c)
            class_start = False
            i += 1
            continue
        if c == "[":
            in_class = True
            out.append(c)
            i += 1
            class_start = True
            if i < n and pattern[i] == "^":
                out.append("^")
                i += 1
            continue
        if c == "(" and pattern.startswith("(?", i):
            rest = pattern[i + 2:]
            if rest.startswith("P<"):
                out.append("(?<")
                i += 4
                continue
            if rest[:1] in ("=", "!", ">") or rest.startswith("<=") or rest.startswith("<!"):
                raise UnsupportedPattern("look-around and atomic groups are not supported")
            flags = ""
            j = 0
            while j < len(rest) and rest[j] not in ":)":
                flags += rest[j]
                j += 1
            if rest[j : j + 1] in (":", ")") and not flags.startswith(("<", "P")) and not set(flags) <= _FLAGS:
                raise UnsupportedPattern(f"(?{flags}) is not supported")
        if c == "{" and re.match(r"\{,\d*\}", pattern[i:]):
            out.append("\\{")
            i += 1
            continue
        if c in "*+?}" and i + 1 < n and pattern[i + 1] == "+":
            raise UnsupportedPattern("possessive quantifiers are not supported")
        out.append(c)
        i += 1
    return "(?du)" + "".join(out)


def _escaped_tail(out: list[str]) -> bool:
    """The last emitted token is an escape such as ``\\d`` (not a literal)."""
    return bool(out) and ((len(out[-1]) == 2 and out[-1].startswith("\\")) or out[-1].startswith("\\Q"))


def _ends_with_word_group(out: list[str]) -> bool:
    text = "".join(out)
    if not text.endswith(")"):
        return False
    k = text.rfind("(")
    return k >= 0 and _WORD_GROUP.fullmatch(text[k:]) is not None


def match(col: Column | str, pattern: str | None, ignore_case: bool = False) -> Column:
    """Does the line match; no pattern matches every line."""
    if not pattern:
        return F.lit(True)
    p = ("(?i)" + pattern) if ignore_case else pattern
    c = F.col(col) if isinstance(col, str) else col
    return c.rlike(to_java(p))


def ignored(col: Column | str, patterns: tuple[str, ...] | list[str]) -> Column:
    """Hit by any noise pattern (always case-sensitive)."""
    c = F.col(col) if isinstance(col, str) else col
    cond = F.lit(False)
    for p in patterns or ():
        cond = cond | c.rlike(to_java(p))
    return cond


def level(col: Column | str) -> Column:
    """fatal > error > warn > info > debug > none, as the level name."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for name, words in LEVEL_WORDS:
        cond = c.rlike(to_java(rf"(?i)\b({words})\b"))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(NO_LEVEL))
