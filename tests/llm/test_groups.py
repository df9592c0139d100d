"""Exact dedup, the conversation trie and whitening against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F
from odd_rows import no_docs, odd_docs  # noqa: F401

from loglens.llm import exact, tries, whitening
from loglens.llm import registry as R
from loglens.llm.common import stored

SF = "/root/testdata/sf0.001"


# ---- exact dedup ------------------------------------------------------------------------

def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_on_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    members = defaultdict(list)
    for k, t in rows:
        members[plain(t)].append(k)
    got = exact.groups(odd_docs).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).digest(): ks for t, ks in members.items()}
    for r in got:
        ks = by_sha[bytes(r.sha)]
        assert (r.keep, r.group_size) == (min((k for k in ks if k is not None), default=None), len(ks))
    assert Counter(bytes(r.sha) for r in got if r.kept) == Counter(by_sha.keys())
    assert all(r._k == r.keep for r in got if r.kept)
    kept = exact.dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(plain(r.text) for r in kept.collect()) == Counter(members.keys())
    assert exact.groups(no_docs).count() == 0 and exact.dedup(no_docs).count() == 0


@pytest.mark.parametrize("parts, rounds", [(1, 0), (7, 1), (40, 2)])
def test_runs_of_many_partitions(spark, parts, rounds):
    rng = random.Random(parts)
    rows = [(i, rng.choice(["hot text", f"text {rng.randrange(60)}", f"own \t{i}"])) for i in range(700)]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), "docs") if parts == 1 else spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    rows_, levels = exact.merge_runs(stored(exact.digests(docs, "doc_id", "text"), "digests"))
    assert len(levels) == rounds + 1
    assert levels[-1].count() == len({plain(t) for _, t in rows})
    least, size = {}, Counter(plain(t) for _, t in rows)
    for k, t in rows:
        least[plain(t)] = min(k, least.get(plain(t), k))
    want = {k: (least[plain(t)], size[plain(t)], least[plain(t)] == k) for k, t in rows}
    assert {r._k: (r.keep, r.group_size, r.kept) for r in exact.groups(docs).collect()} == want


# ---- conversation trie --------------------------------------------------------------------

def plain_trie(convs):
    """convs: {id: [(role, text), ...]}; the rows of the contract."""
    members, kids = defaultdict(list), defaultdict(set)
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
            if d:
                kids[tuple(path[: d - 1])].add(tuple(path[:d]))
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = own + sum(saved[k] for k in kids[node])
    out = Counter()
    for node, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(node))
        out[(min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def rebuilt_plain(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


def trie_rows(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(tuple(r) for r in df.select(cols).collect())


def ordered(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append(((t is not None, t or 0), (role or "", text or "")))
    return {c: [x for _, x in sorted(v)] for c, v in convs.items()}


@pytest.fixture(scope="module")
def odd_turns():
    rng = random.Random(11)
    rows = [(None, 0, "user", "lost"), (5, None, None, "first"), (5, 0, "user", None), (7, 3, None, None), (207, 0, "user", "far from its block"), (300, 1, "user", ""), (301, 1, "user", "")]
    for c in range(8, 110):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, 10 * t, "user" if t % 2 else "assistant", rng.choice(["yes 🙂", "no", "hm"]) if t < 4 else f"{rng.randrange(9)}"))
    for c in range(400, 520):  # a hot conversation
        rows += [(c, t, "user", "the same") for t in range(3)]
    rows += [(600, t, "user", f"w{t}") for t in range(300)] + [(601, t, "user", f"w{t}") for t in range(250)]
    return rows


@pytest.mark.parametrize("long, width", [(1 << 16, None), (16, None), (16, 8)])
def test_trie_against_plain(spark, odd_turns, monkeypatch, long, width):
    """Whatever the length of the pieces, and with a sketch that proves nothing."""
    monkeypatch.setattr(tries, "LONG", long)
    if width:
        monkeypatch.setattr(tries, "sketch_width", lambda n: tries.BLOCK // 4)
        monkeypatch.setattr(tries, "cells", lambda digests, width: np.tile(np.arange(4), (len(digests), 1)))
    turns = spark.createDataFrame(odd_turns, "conv_id long, turn long, role string, text string").withColumn("c", F.lit(1))
    convs = ordered(odd_turns)
    assert trie_rows(tries.trie(*tries.rebuilt(tries.sequences(turns)))) == plain_trie(rebuilt_plain(convs))
    if not width:
        assert trie_rows(tries.prefix_trie(turns)) == plain_trie(convs)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert tries.prefix_trie(none).count() == 0
    assert tries.trie(*tries.rebuilt(tries.sequences(none))).count() == 0


def test_registered_trie(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(R.QUERIES["op11_trie"](spark, SF)) == plain_trie(rebuilt_plain(ordered(rows)))


# ---- whitening ----------------------------------------------------------------------------

def plain_whitening(vectors, components=4):
    x = {k: np.floor(256 * np.array(v, float)).astype(np.int64) for k, v in vectors.items()}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, total = len(fit), fit.sum(0)
    values, axes = np.linalg.eigh(np.cov((fit - total / n).T, bias=True).reshape(fit.shape[1], -1))
    out = {}
    for k, v in x.items():
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, total))
        for c in range(min(components, fit.shape[1])):
            out[k, c + 1] = (n, deviation, abs((v - total / n) @ axes[:, -1 - c] / np.sqrt(values[-1 - c])), values[-1 - c] / values.sum())
    return out


def test_whitening_against_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows += [(10**6, rows[0][1]), (10**6 + 1, rows[0][1])]  # repeated vectors count once in the fit
    odd = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan")] * 64), (5, [float("inf")] * 64), (6, [1e300] * 64), (None, rows[1][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumnRenamed("vec_id", "d")
    got = [r for r in whitening.whiten(df, key="d").collect()]
    want = plain_whitening(dict(rows))
    assert {(r.d, r.component) for r in got if r.d is not None} == set(want) and sum(r.d is None for r in got) == 4
    for r in got:
        n, deviation, whitened, explained = want[r.d if r.d is not None else rows[1][0], r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(abs(r.whitened) - whitened) < 1e-9 and abs(r.explained / explained - 1) < 1e-9 and r.identity_error < 1e-9
    signs = defaultdict(set)
    for r in got:
        if r.d is not None and abs(r.whitened) > 1e-9:
            signs[r.component].add(r.whitened > 0)
    assert all(len(s) == 2 for s in signs.values())


def test_whitening_of_odd_tables(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, -0.5]), (2, [0.5, -0.5])], kind)).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in one} == {(k, c, 1, 0, None, 0.0) for k in (1, 2) for c in (1, 2)}
    # lengths are tables of their own; large numbers stay exact
    big = 2.0**52
    rows = [(1, [1.0]), (2, [3.0]), (3, [big, 0.0, -big]), (4, [-big, 1.0, big]), (5, [0.0, 2.0, big])]
    got = whitening.whiten(spark.createDataFrame(rows, kind)).collect()
    assert Counter(r.vec_id for r in got) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3}
    assert {r.whitened for r in got if r.vec_id < 3} == {-1.0, 1.0}
    x = {k: [int(256 * c) for c in v] for k, v in rows[2:]}
    total = [sum(v[i] for v in x.values()) for i in range(3)]
    for r in got:
        if r.vec_id > 2:
            assert r.deviation == Decimal(sum((3 * a - s) ** 2 for a, s in zip(x[r.vec_id], total)))


def test_polarisation_gives_exact_covariances(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-900, 900, (40, 5))
    fit = spark.createDataFrame([(5, r.tolist()) for r in x], "d int, x array<long>").repartition(3)
    centre = {5: [int(s) // 40 for s in x.sum(0)]}
    z = x - np.array(centre[5])
    got = {(r.i, r.j): sum(int(r[f"l{k}"]) << (whitening.LIMB * k) for k in range(whitening.LIMBS)) for r in whitening.polarised(fit, centre).collect()}
    for j in range(5):
        assert got[-1, j] == z[:, j].sum()
        for i in range(j + 1):
            assert got[i, j] == ((z[:, i] + z[:, j]) ** 2 if i != j else z[:, i] ** 2).sum()
