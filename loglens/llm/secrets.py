"""Secret scans with character Markov models, as DataFrame expressions only.

Patterns find the base spans.  Two models of character pairs, of random
strings and of ordinary identifiers, are trained on the labelled strings of
``secret_samples`` and, with the same weight, on all of the corpus: on those
values of base spans that change often between letters and digits (random)
and on long words of letters (ordinary).  Every distinct sample counts once.
Every other long run of token characters is compared under both; where the
log-likelihood ratio passes ``MARGIN``, the run is one more span, of kind
``markov``.

Edge cases: a null or empty text has no spans; a corpus without any random or
any ordinary sample is judged by the labelled ones; equal rows give equal
results; offsets are code points, ends exclusive; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm import secret_samples
from loglens.llm.common import stored, text_or_empty

# Kinds in their order, patterns, least length of the value or match.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
# Runs that the models judge, and what counts as an ordinary identifier.
RUN = r"[A-Za-z0-9+/_=-]{16,}"
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{12,}(?![A-Za-z0-9+/_=-])"
# Values of base spans are random samples if so long and with so many changes between letters and digits.
LEAST_SAMPLE, LEAST_CHANGES = 16, 3
# A run must be so many times likelier under the random model.
MARGIN = log(1e4)
CODES = 128
PRIOR = 10


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _cut(rows: DataFrame, patterns: list[tuple[str, int]]) -> DataFrame:
    """With the matches m0, m1, ... of the patterns, their groups v0, ... and the gaps between matches g0, ..."""
    columns = {}
    for i, (pattern, group) in enumerate(patterns):
        q = _quoted(pattern)
        for name, found in ((f"g{i}", f"split(_text, {q}, -1)"), (f"m{i}", f"regexp_extract_all(_text, {q}, 0)"), (f"v{i}", f"regexp_extract_all(_text, {q}, {group})")):
            # most texts have no match: they are read once for each pattern
            columns[name] = F.expr(f"CASE WHEN _text RLIKE {q} THEN {found} ELSE CAST(array() AS array<string>) END")
    return rows.withColumns(columns)


def _running(values: str, op: str) -> str:
    """SQL: op (of x and y) of every element and all before it, in doubling steps: array operations of n log n, not of n * n."""
    step = f"(a, k) -> transform(a, (x, i) -> CASE WHEN i >= shiftleft(1, k) THEN {op.replace('y', 'a[i - shiftleft(1, k)]')} ELSE x END)"
    rounds = "sequence(0, CAST(ceil(log2(size(v))) AS int) - 1)"
    # a name for the values, so that they are worked out once
    return f"transform(array({values}), v -> CASE WHEN size(v) > 1 THEN aggregate({rounds}, v, {step}) ELSE v END)[0]"


def _placed(i: int, least: int) -> Column:
    """Array of (first, kind, until, value) of pattern i's matches, as long as the value is: the gaps give the places."""
    lengths = f"zip_with(slice(g{i}, 1, size(m{i})), m{i}, (g, m) -> length(g) + length(m))"
    ends = _running(lengths, "x + y")
    return F.expr(
        f"filter(zip_with({ends}, arrays_zip(m{i}, v{i}), (e, z) -> struct(e - length(z.m{i}) AS first, {i} AS kind, e AS until, z.v{i} AS value)),"
        f" s -> length(s.value) >= {least})"
    )


# Runs that no base span overlaps: in the order of their starts, a run looks at the furthest end of the base spans before it and at the next one's start.
_ALL = "array_sort(concat(transform(base, s -> struct(s.first AS first, s.until AS until, true AS known, s AS span)), transform(runs, s -> struct(s.first AS first, s.until AS until, false AS known, s AS span))))"
_FREE = (
    f"transform(array({_ALL}), w -> transform(array(struct("
    + _running("transform(w, s -> IF(s.known, s.until, -1))", "greatest(x, y)")
    + " AS ends, reverse("
    + _running("reverse(transform(w, s -> IF(s.known, s.first, 2147483647)))", "least(x, y)")
    + ") AS starts)), p -> transform(filter(transform(w, (s, i) -> struct(NOT s.known"
    " AND coalesce(get(p.ends, i - 1), -1) <= s.first AND coalesce(get(p.starts, i + 1), 2147483647) >= s.until AS free, s.span AS span)), t -> t.free), t -> t.span))[0])[0]"
)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_k, base spans, other runs and ordinary identifiers of every row."""
    rows = docs.select(F.col(key).alias("_k"), text_or_empty(text).alias("_text"))
    cut = _cut(rows, [(ASSIGN, 1), (ACCESS, 0), (HEX, 0), (RUN, 0)])
    found = cut.select(
        "_k",
        F.array_sort(F.concat(_placed(0, LEAST_VALUE), _placed(1, 20), _placed(2, 24))).alias("base"),
        _placed(3, 16).alias("runs"),
        F.expr(f"regexp_extract_all(_text, {_quoted(ORDINARY)}, 0)").alias("ordinary"),
    )
    own = F.expr(f"CASE WHEN size(base) = 0 OR size(runs) = 0 THEN runs ELSE {_FREE} END")
    return found.select("_k", "base", own.alias("runs"), "ordinary")


def pair_counts(scanned: DataFrame) -> DataFrame:
    """random (boolean), a, b, n: how often character b follows a in the distinct samples; at most 2 * 128 * 128 rows."""
    random = scanned.select(F.lit(True).alias("random"), F.explode("base.value").alias("s")).withColumn("s", F.expr("rtrim('=', s)"))
    changes = F.regexp_count("s", F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"))
    random = random.where((F.length("s") >= LEAST_SAMPLE) & (changes >= LEAST_CHANGES))
    ordinary = scanned.select(F.lit(False).alias("random"), F.explode("ordinary").alias("s"))
    pairs = "transform(array(split(s, '')), c -> transform(sequence(1, size(c) - 1), i -> ascii(c[i - 1]) * 128 + ascii(c[i])))[0]"
    codes = random.unionByName(ordinary).where(F.length("s") > 1).distinct().select("random", F.explode(F.expr(pairs)).alias("p"))
    counts = codes.groupBy("random", "p").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("random", F.expr("p DIV 128").alias("a"), F.expr("p % 128").alias("b"), "n")


def _class(code: int) -> str:
    x = chr(code)
    return "a" if x.islower() else "A" if x.isupper() else "0" if x.isdigit() else x


CLASSES = [_class(code) for code in range(CODES)]


def _chances(of: dict[tuple[int, int], int]) -> list[float]:
    """The chance of b after a (place 128 * a + b).

    It mixes the counts of the pair with the chance by kinds of characters
    (small, capital, digit or one sign), which weighs as much as PRIOR
    samples: of b's kind after a's kind, and of b in its kind.  Both add one
    to every count.
    """
    token = [i for i in range(CODES) if chr(i).isalnum() or chr(i) in "+/_=-"]
    after, kinds, of_kind, alone = Counter(), Counter(), Counter(), Counter(token)
    for (a, b), n in of.items():
        after[a] += n
        kinds[CLASSES[a], CLASSES[b]] += n
        of_kind[CLASSES[a]] += n
        alone[b] += n
    in_kind = Counter()
    for b, n in alone.items():
        in_kind[CLASSES[b]] += n
    different = len({CLASSES[i] for i in token})

    def chance(a: int, b: int) -> float:
        x, y = CLASSES[a], CLASSES[b]
        by_kind = (kinds[x, y] + 1) / (of_kind[x] + different) * max(alone[b], 1) / max(in_kind[y], 1)
        return (of.get((a, b), 0) + PRIOR * by_kind) / (after[a] + PRIOR)

    return [chance(a, b) for a in range(CODES) for b in range(CODES)]


def ratios(counts: DataFrame) -> list[float]:
    """The log-likelihood ratio of each pair (place 128 * a + b); a model is the mean of the corpus's and the labelled strings'."""
    table: dict[bool, dict[tuple[int, int], int]] = {True: {}, False: {}}
    for r in counts.collect():  # bounded, see pair_counts
        table[r["random"]][r["a"], r["b"]] = r["n"]
    models = {}
    for kind, samples in secret_samples.training().items():
        known = _chances(Counter((ord(a), ord(b)) for s in samples for a, b in zip(s, s[1:])))
        models[kind] = [(x + y) / 2 for x, y in zip(known, _chances(table[kind]))] if table[kind] else known
    return [log(x) - log(y) for x, y in zip(models[True], models[False])]


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", margin: float = MARGIN) -> DataFrame:
    """key, base and spans: arrays of (first, kind, until, value), in order; kind 3 is what the models add."""
    scanned = stored(scan(docs, key, text), "secret-scan")  # spans and long words only, so the texts are read once
    ratio = F.lit(ratios(pair_counts(scanned))).cast("array<double>")

    def score(run: Column) -> Column:
        start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("total"))

        def add(a: Column, c: Column) -> Column:
            code = F.ascii(c)
            here = F.when(a["last"] < 0, F.lit(0.0)).otherwise(F.element_at(ratio, F.greatest(a["last"], F.lit(0)) * CODES + code + 1))
            return F.struct(code.alias("last"), (a["total"] + here).alias("total"))

        return F.aggregate(F.split(run["value"], ""), start, add, lambda a: a["total"])

    added = F.filter("runs", lambda r: score(r) > margin)
    return scanned.select(F.col("_k").alias(key), "base", F.array_sort(F.concat("base", added)).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of the spans, joined by commas."""
    names = ", ".join(f"'{k}'" for k in (*KINDS, "markov"))
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', array({names})[s.kind], s.first, s.until)), ',')")


def count_of(kind: str) -> Column:
    return F.expr(f"CAST(size(filter(base, s -> s.kind = {KINDS.index(kind)})) AS bigint)")
