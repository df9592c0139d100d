"""DuckDB SQL text for the oracle side of the registered queries.

These strings are only used to *check* the Spark plans: DuckDB runs RE2
(the dialect users write), so the oracle is an independent check of the
regex translation and of the time layouts.
"""

from __future__ import annotations

from loglens.functions.timeparse import LAYOUTS, MIN_PREFIX, SPACE_CLASS

_DUCK_FORMATS = (
    None,
    "%Y-%m-%d %H:%M:%S.%g",
    "%Y-%m-%d %H:%M:%S",
    "%Y/%m/%d %H:%M:%S",
    "%m/%d/%Y %H:%M:%S",
    "%Y %b %d %H:%M:%S",
)


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def prefix_time(expr: str, year: int) -> str:
    parts = []
    for (tok_re, width, _), fmt in zip(LAYOUTS, _DUCK_FORMATS):
        tok = f"regexp_extract({expr}, {q('^(' + tok_re + ')')}, 1)"
        norm = f"replace(regexp_replace({tok}, ' +', ' ', 'g'), ',', '.')"
        ok = f"length({tok}) BETWEEN 1 AND {width}"
        if width == MIN_PREFIX:
            after = f"regexp_extract({expr}, {q('^(?:' + tok_re + ')(' + SPACE_CLASS + '?)')}, 1)"
            ok = f"({ok} AND (length({tok}) = {MIN_PREFIX} OR {after} <> ''))"
        if fmt is None:
            parsed = f"timezone('UTC', TRY_CAST({norm} AS TIMESTAMPTZ))"
        elif fmt.startswith("%Y %b"):
            parsed = f"try_strptime(concat('{year} ', {norm}), '{fmt}')"
        else:
            parsed = f"try_strptime({norm}, '{fmt}')"
        parts.append(f"CASE WHEN {ok} THEN {parsed} END")
    return "coalesce(" + ", ".join(parts) + ")"


def trim_space(expr: str) -> str:
    return f"regexp_replace({expr}, {q('^' + SPACE_CLASS + '+|' + SPACE_CLASS + '+$')}, '', 'g')"


def json_time(expr: str, year: int) -> str:
    t = trim_space(expr)
    keys = ["$.timestamp", "$.time", "$.ts", '$."@timestamp"']
    c = ", ".join(prefix_time(f"json_extract_string({t}, '{k}')", year) for k in keys)
    return (f"CASE WHEN starts_with({t}, '{{') AND ends_with({t}, '}}') AND json_valid({t}) "
            f"THEN coalesce({c}) END")


def line_time(expr: str, year: int) -> str:
    return f"coalesce({json_time(expr, year)}, {prefix_time(trim_space(expr), year)})"


def ts_text(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"
