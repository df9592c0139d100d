"""The search semantics as sets of positions of one file, for random tests."""

from __future__ import annotations

import re
from itertools import groupby


def selected(lines, pattern, before=0, after=0, ignore=()):
    """Positions of the lines that a search returns."""
    noise = {p for p, line in enumerate(lines) if any(re.search(x, line) for x in ignore)}
    usable = set(range(len(lines))) - noise
    if pattern is None:
        return usable
    hits = {p for p in usable if re.search(pattern, lines[p])}
    return {p for p in usable if hits & set(range(p - after, p + before + 1))}


def output(lines, pattern, before=0, after=0, ignore=(), runs=False):
    """(line_no, sub, text) of the output, sub 0 being a gap marker."""
    chosen = selected(lines, pattern, before, after, ignore)
    marked = {p for p in chosen if p - 1 not in chosen and p != min(chosen)} if pattern is not None else set()
    rows = sorted([(p, 1, lines[p]) for p in chosen] + [(p, 0, "--") for p in marked])
    if not runs:
        return rows
    out, part = [], 0
    keyed = []
    for p, sub, text in rows:
        part += sub == 0
        keyed.append(((part, sub, text), p))
    for (_, sub, text), members in groupby(keyed, key=lambda x: x[0]):
        members = [p for _, p in members]
        out.append((members[0], sub, text if len(members) == 1 else f"{text}  × {len(members)}"))
    return out
