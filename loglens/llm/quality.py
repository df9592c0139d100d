"""Quality rules with risk-controlled thresholds.

``measure`` counts, ``fit`` picks cutoffs, ``judge`` applies them; all three
are DataFrame expressions.

A rule rejects a document whose feature (an integer, per thousand) is at or
over a cutoff.  The sets of rules tried grow in a sequence fixed beforehand
(``SEQUENCE``), so every labelled document is a holdout for all of them.  In a
stratum (a language), a set is certified if the exact binomial test refutes,
at the error level divided by the number of strata (Bonferroni), that the set
as a whole rejects ``limit`` or more of the good documents.  Tests in a fixed
order up to the first that fails need no other correction; as the sets grow,
so do their rejections, and those certified are the first ones.  Of these, the
one counts that rejects most bad documents less good ones; on a tie, the
smallest.  Strata without labels, or with too few, or where no set pays,
reject nothing.

Edge cases: a null text has no words and fails the base rule (fewer than 50
words); a null language is a stratum of its own; rows of ``labels`` with a
null doc_id or quality don't count; of repeated labels of a document the
lowest quality counts; empty tables give empty results, and without labels
only the base rule rejects; repeated documents are judged each for itself;
other columns, whatever their names, pass through ``judge`` unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import SPACES, text_or_empty, words

# Share of a stratum's good documents that its rules may reject together, and the chance that any stratum's exceed it.
LIMIT = 0.01
ERROR = 0.05
# Cutoffs tried, per thousand.
CUTOFFS = {
    "symbols": (50, 100, 200, 400, 800),  # symbols to words
    "dup_lines": (400, 500, 600, 700, 800),  # lines with a word that repeat an earlier one, to lines
    "repeats": (200, 300, 400, 500),  # words in repeated 3-word windows, to words
    "same_next": (50, 100, 200, 400),  # words equal to the one before, to words
    "capitals": (200, 300, 400, 500),  # A-Z to characters in words
    "shouts": (100, 200, 400, 800),  # exclamation marks to words
}
# Each step adds a rule or lowers its cutoff: the mildest cutoff of every rule, then the next ones.
SEQUENCE = tuple((rule, cs[-1 - i]) for i in range(max(map(len, CUTOFFS.values()))) for rule, cs in CUTOFFS.items() if i < len(cs))
SYMBOLS = "#*$%&|<>"
# Strata whose cutoffs are written into the plan as a constant; beyond that they are joined.
LISTED_STRATA = 500

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The counts and features of every row, with the columns ``keep`` as ``_row`` (all if None)."""
    row = F.struct(*(keep if keep is not None else docs.columns))
    rows = docs.select(row.alias("_row"), text_or_empty(text).alias("_text")).withColumn("_words", words(F.col("_text")))
    windows = "transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2]))"
    rows = rows.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "_windows": F.expr(f"CASE WHEN size(_words) >= 3 THEN {windows} ELSE CAST(array() AS array<bigint>) END"),
            "_lines": F.expr(r"filter(split(_text, '\n', -1), x -> x RLIKE '[^\\x20\\x09-\\x0D]')"),
        }
    )
    # window hashes in order, each with its place, where any of them repeats
    rows = rows.withColumn(
        "_sorted",
        F.expr(
            "CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN"
            " array_sort(transform(_windows, (x, i) -> struct(x AS h, i AS p))) END"
        ),
    )
    rows = rows.withColumn(
        "_starts",
        F.expr("sort_array(transform(filter(_sorted, (e, i) -> e.h = get(_sorted, i - 1).h OR e.h = get(_sorted, i + 1).h), e -> e.p))"),
    )
    rows = rows.withColumns(
        {
            "word_chars": F.length(F.translate("_text", SPACES, "")).cast("long"),
            "n_symbols": _count_of(F.col("_text"), SYMBOLS),
            "n_dup_lines": F.expr("CAST(size(_lines) - size(array_distinct(_lines)) AS bigint)"),
            "n_repeat_words": F.expr(
                "CASE WHEN _starts IS NULL THEN 0L ELSE CAST(aggregate(_starts, struct(-3 AS last, 0 AS n),"
                " (a, p) -> struct(p AS last, a.n + least(3, p - a.last) AS n), a -> a.n) AS bigint) END"
            ),
            "_same": F.expr(
                "CASE WHEN size(_words) < 2 THEN 0 ELSE size(filter(sequence(1, size(_words) - 1), i -> _words[i] = _words[i - 1])) END"
            ),
            "_n_lines": F.size("_lines"),
            "_capitals": _count_of(F.col("_text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            "_shouts": _count_of(F.col("_text"), "!"),
        }
    )

    def share(part: str, whole: str) -> Column:
        return F.expr(f"CASE WHEN {whole} > 0 THEN (1000L * {part}) DIV {whole} ELSE 0L END")

    features = {
        "symbols": share("n_symbols", "n_words"),
        "dup_lines": share("n_dup_lines", "_n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "same_next": share("_same", "n_words"),
        "capitals": share("_capitals", "word_chars"),
        "shouts": share("_shouts", "n_words"),
    }
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return rows.select("_row", *METRICS, failed.alias("base_failed"), F.struct(*(v.alias(k) for k, v in features.items())).alias("_features"))


def _binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) of a binomial(n, p) variable, summed in logarithms."""
    first = f"{{n}} * ln(1D - {p!r}D)"
    step = f"a.term + ln(({{n}} - i + 1D) / i) + ln({p!r}D / (1D - {p!r}D))"
    added = "greatest(a.total, {t}) + log1p(exp(-abs(a.total - ({t}))))"
    sql = (
        f"exp(aggregate(CASE WHEN {{k}} > 0 THEN sequence(1L, {{k}}) ELSE CAST(array() AS array<bigint>) END,"
        f" struct({first} AS term, {first} AS total), (a, i) -> struct({step} AS term, {added.format(t=step)} AS total), a -> a.total))"
    )
    return F.expr(sql.format(n="_n", k="_k"))


def first_step(prefix: str = "") -> str:
    """SQL: the first step of SEQUENCE (from 1) that rejects a row with these features; more than any if none does."""
    cases = []
    for rule in CUTOFFS:
        steps = [(c, i) for i, (r, c) in enumerate(SEQUENCE, 1) if r == rule]
        cases.append("CASE " + " ".join(f"WHEN {prefix}{rule} >= {c} THEN {i}" for c, i in steps) + f" ELSE {len(SEQUENCE) + 1} END")
    return f"least({', '.join(cases)})"


def fit(measured: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """stratum, rule, cutoff of every rule that rejects; ``_row`` of measured holds key and stratum."""
    quality = (
        labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.min("quality").alias("_quality"))
    )
    known = measured.select(F.col(f"_row.{key}").alias("_id"), F.col(f"_row.{stratum}").alias("_stratum"), F.expr(first_step("_features.")).alias("_first"))
    known = known.join(quality, "_id").withColumn("_good", F.col("_quality") > 0)
    steps = range(1, len(SEQUENCE) + 1)
    # one row a stratum: partial sums before any shuffle, so a large stratum is no hot key
    counts = known.groupBy("_stratum").agg(
        F.count_if("_good").alias("_n"),
        F.array(*(F.struct(F.lit(i).alias("step"), F.count_if(F.col("_good") & (F.col("_first") <= i)).alias("k"), F.count_if(~F.col("_good") & (F.col("_first") <= i)).alias("bad")) for i in steps)).alias("_sets"),
    )
    table = counts.withColumn("_strata", F.count(F.lit(1)).over(_whole())).select("_stratum", "_strata", "_n", F.inline("_sets")).withColumnRenamed("k", "_k")
    certified = table.where((F.col("_n") > 0) & (F.col("_k") <= F.col("_n") * limit) & (F.col("bad") > F.col("_k")))
    certified = certified.where(_binomial_tail(F.col("_n"), F.col("_k"), limit) <= F.lit(error) / F.col("_strata"))
    best = certified.groupBy("_stratum").agg(F.max(F.struct((F.col("bad") - F.col("_k")).alias("gain"), (-F.col("step")).alias("less"))).alias("_best"))
    rules = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(r).alias("rule"), F.lit(c).alias("cutoff")) for i, (r, c) in enumerate(SEQUENCE, 1)))
    chosen = best.select(F.col("_stratum").alias("stratum"), F.inline(F.filter(rules, lambda x: x["step"] <= -F.col("_best.less"))))
    return chosen.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def _whole():
    """All strata, one row each, to count them."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """measured with ``kept``: the base rule and every rule of the row's stratum passed."""
    by_stratum = cutoffs.groupBy("stratum").pivot("rule", list(CUTOFFS)).agg(F.min("cutoff"))
    found = by_stratum.limit(LISTED_STRATA + 1).collect()  # at most LISTED_STRATA + 1 rows of 7 numbers
    own = F.col(f"_row.{stratum}")
    if len(found) > LISTED_STRATA:
        joined = measured.join(by_stratum.withColumnRenamed("stratum", "_stratum"), own.eqNullSafe(F.col("_stratum")), "left")
        rejects = [F.coalesce(F.col(f"_features.{r}") >= F.col(r), F.lit(False)) for r in CUTOFFS]
        return joined.withColumn("kept", ~(F.col("base_failed") | _any(rejects))).drop("_stratum", *CUTOFFS)
    rejects = [own.eqNullSafe(F.lit(x["stratum"])) & (F.col(f"_features.{r}") >= x[r]) for x in found for r in CUTOFFS if x[r] is not None]
    return measured.withColumn("kept", ~(F.col("base_failed") | _any(rejects)))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
