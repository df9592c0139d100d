"""Glob patterns.

Globs are small driver-side strings; each becomes one anchored Java regex
that runs inside ``rlike`` (no UDF).  Semantics: a full match of the path;
``*`` and ``?`` stop at ``/``; ``**/`` may match nothing; ``**`` matches
anything; every other character -- ``[`` included -- is literal.
"""

from __future__ import annotations

import os
import posixpath
import re
from itertools import takewhile

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each token of a glob stands for; any other character stands for itself.
_TOKENS = re.compile(r"\*\*/|\*\*|\*|\?|.", re.S)
_MEANINGS = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
_WILD = re.compile(r"[*?\[]")


def expand_home(p: str) -> str:
    return os.path.expanduser(p) if p.startswith("~") else p


def clean(p: str) -> str:
    """Lexical clean like the original tool's path handling (no file access)."""
    if not p:
        return "."
    out = posixpath.normpath(p)
    if out.startswith("//"):
        out = "/" + out.lstrip("/")
    return out


def glob_to_regex(pattern: str) -> str:
    """glob -> anchored regex (valid in Java and in RE2)."""
    tokens = _TOKENS.findall(clean(expand_home(pattern)))
    return "^" + "".join(_MEANINGS.get(t) or re.sub(r"[^\w/\s]", r"\\\g<0>", t, flags=re.A) for t in tokens) + "$"


def glob_match(col: Column | str, pattern: str) -> Column:
    """Full-path glob match as a Column predicate."""
    c = F.col(col) if isinstance(col, str) else col
    return c.rlike("(?s)" + glob_to_regex(pattern))


def has_meta(s: str) -> bool:
    return _WILD.search(s) is not None


def literal_root(pattern: str) -> str:
    """the directory a glob can be listed from: its components before the first with a wildcard."""
    p = expand_home(pattern)
    if not has_meta(p):
        return p
    plain = list(takewhile(lambda part: not has_meta(part), p.split("/")))
    return "/".join(plain) or ("/" if p.startswith("/") else ".")


def check_root(pattern: str) -> str:
    """F6 guard: refuse to list from the filesystem root."""
    root = literal_root(pattern)
    if clean(root) == "/":
        raise ValueError("refusing to recursively scan filesystem root")
    return root
