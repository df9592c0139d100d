"""The registered queries and the pipeline as a whole."""

import re
from collections import Counter

import public_tokenizers
import pytest
from odd_rows import no_docs, odd_docs  # noqa: F401
from test_corpus import line_dedup, links, plain_metrics
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline

SF = "/root/testdata/sf0.001"
NAMES = ["op1_html", "op2_substrings", "op3_secrets", "op4_jaccard", "op5_bpe", "op6_licenses", "op7_lines", "op8_decontam", "op9_quality", "op10_shards", "pipeline"]


def test_all_registered():
    assert set(NAMES) <= set(E.queries())


@pytest.mark.parametrize("name, column", [("op1_html", "page_id"), ("op2_substrings", "doc_id"), ("op3_secrets", "doc_id"), ("op10_shards", "doc_id")])
def test_one_row_for_each(spark, name, column):
    got = E.queries()[name](spark, SF)
    whole = spark.read.parquet(f"{SF}/{'pages' if name == 'op1_html' else 'documents'}.parquet")
    assert Counter(r[0] for r in got.select(column).collect()) == Counter(r[0] for r in whole.select(column).collect())


def bare(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def leaks(text, items):
    w = bare(text)
    own = {tuple(w[i : i + 5]): i for i in range(len(w) - 4)}
    for item in items:
        grams = Counter(tuple(item[i : i + 5]) for i in range(len(item) - 4))
        for q in range(len(item) - 4):
            p = own.get(tuple(item[q : q + 5]))
            if p is not None:
                start = max(0, p - q)
                window = w[start : start + len(item)]
                theirs = Counter(tuple(window[i : i + 5]) for i in range(len(window) - 4))
                if sum((grams & theirs).values()) >= 0.8 * sum((grams | theirs).values()):
                    return True
    return False


def test_pipeline_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [bare(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    metrics = {d: plain_metrics(t) for d, t in rows}
    # there are too few labels here for any cutoff
    rows = [(d, t) for d, t in rows if not (metrics[d][0] < 50 or 100 * metrics[d][4] > 50 * metrics[d][0])]
    rows = [(d, kept) for d, _, _, kept in line_dedup(rows)]
    first = {d: c for d, _, c in links(rows, 5, 80)}
    rows = [(d, t) for d, t in rows if first[d] == d]
    rows = [(d, t) for d, t in rows if not leaks(t, items)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in rows}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_on_odd_and_empty_rows(spark, odd_docs, no_docs):
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    for docs in (odd_docs, no_docs):
        docs = docs.withColumn("n_chars", docs.n_words)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
            if name != "quality rules":
                docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, SF).count() == 0
    assert len(corpus_pipeline.STAGES) == 5 and whole.columns == ["doc_id", "text", "lang", "source", "n_chars"]
