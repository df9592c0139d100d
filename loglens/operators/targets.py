"""Targets to files: one plan from a list of target words to a set of paths.

A target is, in this order: nothing at all (the newest files of the
catalog), the name of a group, ``@process``, ``:port``, a path (file,
directory or glob), or a name that the ranked lookup finds.  Which kind a
target is depends on the word and the configured groups alone, so the driver
decides it without looking at files; what it selects is a DataFrame.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.config import DEFAULT_MAX_FILES
from loglens.functions.glob import has_meta
from loglens.operators import files as FL
from loglens.operators import inventory as INV


def kind_of(target: str, groups: Mapping[str, Sequence[str]]) -> str:
    """group, process, port, path or name."""
    if target in groups or target in FL.BUILTIN_GROUPS:
        return "group"
    if target.startswith("@") and len(target) > 1:
        return "process"
    if target.startswith(":") and target[1:].isdigit():
        return "port"
    return "path" if "/" in target or target.startswith("~") or has_meta(target) else "name"


def resolve_targets(
    files: DataFrame,
    targets: Sequence[str],
    roots: Sequence[str],
    groups: Mapping[str, Sequence[str]] | None = None,
    proc_fds: DataFrame | None = None,
    listeners: DataFrame | None = None,
    excludes: Sequence[str] = (),
    history: bool = True,
    max_files: int = DEFAULT_MAX_FILES,
) -> DataFrame:
    """Distinct ``path`` of all files that the targets select.

    ``targets`` may hold comma-separated lists.  With ``history``, rotated
    siblings of what was selected are added (J1).  Excludes don't apply to
    files that a process or port holds open.
    """
    groups = dict(groups or {})
    words = FL.split_targets(targets)
    listed = FL.catalog(files, roots, excludes, history=history)
    found: list[DataFrame] = [] if words else [FL.newest(listed, max_files, history)]
    for target in words:
        kind = kind_of(target, groups)
        if kind == "group":
            chosen = FL.resolve_groups(files, groups, excludes, history).where(F.col("name") == target)
        elif kind in ("process", "port"):
            if proc_fds is None or (kind == "port" and listeners is None):
                raise ValueError(f"{target}: needs the inventory tables")
            word = target[1:]
            chosen = INV.logs_of_process(proc_fds, word, files) if kind == "process" else INV.logs_of_port(listeners, proc_fds, int(word), files)
        elif kind == "path":
            chosen = FL.resolve_groups(files, {"path": [target]}, excludes, history, builtin=False)
        else:
            chosen = FL.find_source(listed, target, max_files)
        found.append(chosen)
    paths = FL.union_sources(*found)
    if not history or not words:
        return paths
    return FL.union_sources(paths, FL.rotated_siblings(paths, files, excludes))
