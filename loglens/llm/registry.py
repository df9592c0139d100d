"""Registered queries of this package: ``opN_<name>`` over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from loglens.llm import bpe, decontam, exact, html_text, jaccard, licenses, lines, quality, secrets, shards, substrings, tries, whitening
from loglens.llm.common import stored, table, text_or_empty

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and decoded text."""
    coded = bpe.encode(table(spark, sf_dir, "documents"), word_vocabulary())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query
def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many line dedup drops, and a digest of what stays."""
    deduped = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return deduped.select("_row.doc_id", "n_lines", "n_dropped", F.sha2(text_or_empty("_kept"), 256).alias("kept_sha256"))


ORACLES["op7_lines"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents),
k AS (
  SELECT doc_id, n, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE c.key IS NOT NULL AND doc_id <> c.last) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE c.key IS NULL OR doc_id = c.last), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key
GROUP BY doc_id
"""


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the quality verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    measured = stored(quality.measure(docs, keep=["doc_id", "lang"]), "quality")  # numbers only, so the texts are read once
    judged = quality.judge(measured, quality.fit(measured, table(spark, sf_dir, "labels")))
    return judged.select("_row.doc_id", *quality.METRICS, "base_failed", "kept")


def _quality_sql() -> str:
    p, steps = quality.LIMIT, len(quality.SEQUENCE)
    return rf"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls
  FROM documents),
g AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, ws[p], ws[p + 1], ws[p + 2]) AS n
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS p FROM w)),
r AS (
  SELECT doc_id, sum(least(3, coalesce(next - p, 3))) AS n_repeat_words
  FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS next FROM g WHERE n > 1)
  GROUP BY doc_id),
b AS (
  SELECT doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(ls) AS n_ls,
         len(list_filter(generate_series(2, len(ws)), lambda i: ws[i] = ws[i - 1])) AS n_same,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_caps, length(regexp_replace(text, '[^!]', '', 'g')) AS n_shouts
  FROM w LEFT JOIN r USING (doc_id)),
m AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         coalesce(1000 * n_symbols // nullif(n_words, 0), 0) AS symbols, coalesce(1000 * n_dup_lines // nullif(n_ls, 0), 0) AS dup_lines,
         coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) AS repeats, coalesce(1000 * n_same // nullif(n_words, 0), 0) AS same_next,
         coalesce(1000 * n_caps // nullif(word_chars, 0), 0) AS capitals, coalesce(1000 * n_shouts // nullif(n_words, 0), 0) AS shouts
  FROM b),
f AS (SELECT *, {quality.first_step()} AS first_step FROM m),
h AS (SELECT f.lang, first_step, quality FROM f JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id)),
s AS (
  SELECT lang, step, count(*) FILTER (WHERE quality > 0) AS n,
         count(*) FILTER (WHERE quality > 0 AND first_step <= step) AS k,
         count(*) FILTER (WHERE quality <= 0 AND first_step <= step) AS bad
  FROM h CROSS JOIN (SELECT unnest(generate_series(1, {steps})) AS step) GROUP BY ALL),
q AS (
  SELECT *, list_sum(list_transform(generate_series(0, k), lambda i:
           exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({p}) + (n - i) * ln(1 - {p})))) AS tail
  FROM s WHERE n > 0 AND k <= n * {p} AND bad > k),
c AS (
  SELECT lang, -max({{'gain': bad - k, 'less': -step}}).less AS last_step FROM q
  WHERE tail <= {quality.ERROR} / (SELECT count(*) FROM (SELECT DISTINCT lang FROM h)) GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM c WHERE c.lang IS NOT DISTINCT FROM f.lang AND f.first_step <= c.last_step) AS kept
FROM f
"""


ORACLES["op9_quality"] = _quality_sql()


@query
def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard among 40 of near equal bytes, and its slot there."""
    placed = shards.shard(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document by links of Jaccard similarity of at least 0.85 on 4-word shingles."""
    return jaccard.join(table(spark, sf_dir, "documents"), size=4, percent=85).withColumnRenamed("component", "component_id")


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: what the patterns find and what the Markov models add."""
    found = secrets.find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(secrets.count_of(k).alias(f"n_{k}") for k in secrets.KINDS),
        F.sha2(secrets.listed("base"), 256).alias("base_sha256"),
        secrets.listed("spans").alias("spans"),
    )


@query
def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the bytes of 100-byte strings that start earlier too."""
    cut = substrings.dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark: the best window for each item."""
    found = decontam.best(decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select(F.col("_k").alias("doc_id"), F.col("item").alias("item_id"), F.col("first").alias("first_word"), "shared", "total").distinct()


ORACLES["op8_decontam"] = r"""
WITH b AS (
  SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark),
i AS (
  SELECT item_id, ws, len(ws) AS n, least(len(ws), 5) AS k,
         list_transform(generate_series(1, len(ws) - least(len(ws), 5) + 1), lambda p: array_to_string(ws[p : p + least(len(ws), 5) - 1], ' ')) AS sh
  FROM b WHERE len(ws) > 0),
d AS (
  SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
ds AS (
  SELECT doc_id, ws, k, p, array_to_string(ws[p : p + k - 1], ' ') AS s
  FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM i))),
isx AS (SELECT n, k, q, sh[q] AS s FROM (SELECT n, k, sh, unnest(generate_series(1, len(sh))) AS q FROM i)),
w AS (
  SELECT DISTINCT doc_id, isx.n, isx.k, greatest(p - q, 0) AS f, ws[greatest(p - q, 0) + 1 : greatest(p - q, 0) + isx.n] AS ww
  FROM ds JOIN isx ON ds.s = isx.s AND ds.k = isx.k),
x AS (
  SELECT doc_id, n, k, f, list_transform(generate_series(1, len(ww) - k + 1), lambda p: array_to_string(ww[p : p + k - 1], ' ')) AS sh FROM w),
pairs AS (
  SELECT x.doc_id, item_id, f, x.sh AS a, i.sh AS b FROM x JOIN i ON x.k = i.k WHERE list_has_any(x.sh, i.sh)),
sim AS (
  SELECT *, CAST(list_sum(list_transform(list_distinct(list_concat(a, b)), lambda s:
           least(len(list_filter(a, lambda t: t = s)), len(list_filter(b, lambda t: t = s))))) AS BIGINT) AS shared
  FROM pairs),
ok AS (SELECT *, len(a) + len(b) - shared AS total FROM sim WHERE 100 * shared >= 80 * (len(a) + len(b) - shared))
SELECT doc_id, item_id, CAST(first_word AS BIGINT) AS first_word, shared, CAST(total AS BIGINT) AS total FROM (
  SELECT doc_id, item_id, f AS first_word, shared, total,
         row_number() OVER (PARTITION BY doc_id, item_id ORDER BY CAST(trunc(shared * 1000000.0 / total) AS BIGINT) DESC, f, shared DESC) AS r FROM ok)
WHERE r = 1
"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of equal texts stays, for every document."""
    found = exact.groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("_k").alias("doc_id"), F.col("keep").alias("keep_id"), "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


ORACLES["op12_exact"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding whitened on the first four components."""
    done = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return done.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


@query
def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations, a row for each node."""
    seq, turnless = tries.rebuilt(tries.sequences(table(spark, sf_dir, "conversations")))
    return tries.trie(seq, turnless)


# CRC-32 of the decimal id, bit by bit
_CRC32 = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, zero: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT)"""

ORACLES["op11_trie"] = f"""
WITH t AS (
  SELECT conv_id, list([coalesce(role, ''), coalesce(text, '')] ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, own, CAST({_CRC32} % 6 AS BIGINT) AS h FROM t),
r AS (
  SELECT h.conv_id, list_concat(coalesce(t.own, [])[1:h], h.own[h + 1:]) AS path
  FROM h LEFT JOIN t ON t.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, path, unnest(generate_series(0, len(path))) AS depth FROM r),
m AS (SELECT conv_id, depth, path[1:depth] AS node, depth = len(path) AS ends FROM p),
n AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, bool_and(ends) AS leaf,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM m GROUP BY node, depth),
w AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(node[depth][2]) END AS w FROM n),
s AS (
  SELECT up, CAST(sum(leaf::INT) AS BIGINT) AS n_leaves, CAST(sum(w) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE d = depth - 1) AS n_children
  FROM (SELECT leaf, w, depth, d, node[1:d] AS up FROM (SELECT *, unnest(generate_series(0, depth)) AS d FROM w)) GROUP BY up)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN s ON s.up = n.node LEFT JOIN n AS q ON n.depth > 0 AND q.node = n.node[1:n.depth - 1]
"""
