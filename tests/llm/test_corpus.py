"""Operators over all documents against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd_rows import no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from loglens.llm import decontam, graph, jaccard, lines, quality, shards, substrings

LOW = "".maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def mixed(spark, odd_docs):
    """The odd rows and near copies, shared passages and ordinary texts."""

    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([6, 20, 60, 150]))] for _ in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(240):
        w = list(base[rng.randrange(len(base))])
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            w[3:3] = passage
        rows.append((100 + i, rng.choice([" ", "\n", "\t"]).join(w).replace("w1", rng.choice(["w1", "W1"]))))
    return odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("n", F.lit(0))


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def removed(rows, width):
    """Of each distinct (id, text): the flags of its removed bytes."""
    seen, out = set(), {}
    for key in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (key[1] or "").encode()
        flags = bytearray(len(data))
        own = [data[p : p + width] for p in range(len(data) - width + 1)]
        for p, w in enumerate(own):
            if w in seen:
                flags[p : p + width] = b"\x01" * width
            seen.add(w)
        out[key] = (data, bytes(flags))
    return out


@pytest.mark.parametrize("most", [2, 1 << 16])
def test_substrings(mixed, most):
    rows = [r for r in rows_of(mixed) if r[0] is not None or r[1] != rows_of(mixed)[4][1]]
    docs = mixed.where("doc_id IS NOT NULL")
    got = substrings.dedup(docs, most_in_group=most)
    want = Counter()
    flags = removed([r for r in rows if r[0] is not None], 100)
    for r in rows:
        if r[0] is not None:
            data, gone = flags[r]
            spans = tuple(m.span() for m in re.finditer(b"\x01+", gone))
            want[r[0], len(data), spans, bytes(b for b, g in zip(data, gone) if not g)] += 1
    assert Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got.collect()) == want


def test_windows_over_nul_bytes():
    """A string may end at a NUL that lies inside the others: the pad beside it is no byte."""
    rng = random.Random(6)
    for _ in range(20):
        body = bytearray(rng.randrange(256) for _ in range(168))
        for at in rng.sample(range(100, 168), 9):
            body[at] = 0
        body[130] = 0
        segs = [bytes(body[: rng.choice([131, 115, 140, 168])]) for _ in range(5)] + [bytes(body)]
        segs[0] = bytes(body[:131])
        offs, rank = np.full(len(segs), 50), np.arange(len(segs))
        got = substrings.doomed_windows(np.zeros(len(segs)), rank, segs, offs)
        for i, s in enumerate(segs):
            want = [any(s[c : c + 100] == t[c : c + 100] and len(t) >= c + 100 for t in segs[:i]) for c in range(len(s) - 99)]
            assert got[i, : len(want)].tolist() == want


def test_substrings_edges(spark, odd_docs, no_docs):
    assert substrings.dedup(no_docs).count() == 0
    got = substrings.dedup(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[1].n_bytes == 0 and by_id[1].spans == [] and by_id[4].kept == b"one"
    assert not by_id[5].kept and not by_id[6].kept  # a null id comes first and keeps the passage
    assert len(by_id[10].spans) == 1  # repeats inside one text: all but the first window


def test_anchor_hashes_of_repetitive_bytes():
    import numpy as np

    rng = random.Random(4)
    for _ in range(30):
        parts = [bytes(rng.choice([97, 98]) for _ in range(rng.randint(1, 9))) * rng.randint(1, 60) for _ in range(6)]
        texts = [b"".join(rng.choice(parts) for _ in range(rng.randint(0, 5))) for _ in range(5)]
        offsets = np.cumsum([0, *map(len, texts)])
        of, h, place, first, last = substrings.anchors(np.frombuffer(b"".join(texts), np.uint8), offsets)
        covered = [p for f, l in zip(first, last) for p in range(f, l + 1)]
        assert covered == [o + p for o, t in zip(offsets, texts) for p in range(len(t) - 99)]
        assert all(f <= x <= f + 68 and l <= x for x, f, l in zip(place, first, last))


def links(rows, size, percent):
    sets = []
    for _, text in rows:
        w = words((text or "").translate(LOW))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return Counter((d, len(s), None if d is None else min(least[root(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80), (2, 30)])
def test_jaccard(mixed, no_docs, size, percent):
    got = jaccard.join(mixed, size, percent)
    assert Counter(map(tuple, got.collect())) == links(rows_of(mixed), size, percent)
    if size == 4:
        assert jaccard.join(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    rng.shuffle(edges)
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def line_dedup(rows, least_chars=20, least_docs=3):
    holders = defaultdict(list)
    for d, text in rows:
        for key in {x.strip(SPACE).translate(LOW) for x in (text or "").split("\n")}:
            if len(key) >= least_chars:
                holders[key].append(d)
    last = {k: max(v, key=lambda d: (d is not None, d or 0)) for k, v in holders.items() if len(v) >= least_docs}
    out = Counter()
    for d, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if last.get(x.strip(SPACE).translate(LOW), d) == d]
        out[d, len(own), len(own) - len(kept), "\n".join(kept)] += 1
    return out


def test_lines(spark, mixed, no_docs):
    rng = random.Random(8)
    pool = [f"Line number {i} of the pool, " + "é" * (i % 4) for i in range(40)] + ["short", "", "  "]
    more = [(1000 + i, "\n".join(rng.choice(pool).upper() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    docs = mixed.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumn("_hash", F.lit("x"))
    got = lines.dedup_lines(docs)
    assert Counter((r._row.doc_id, r.n_lines, r.n_dropped, r._kept or "") for r in got.collect()) == line_dedup(rows_of(docs))
    assert lines.dedup_lines(no_docs).count() == 0
    assert got.select("_row.*").columns == docs.columns


def test_full_filters_change_nothing(monkeypatch, mixed):
    monkeypatch.setattr(lines, "MOST_BITS", lines.BLOCK_BITS)
    monkeypatch.setattr(lines, "BLOCK_BITS", 64)
    monkeypatch.setattr(lines, "MOST_BITS", 64)
    got = lines.dedup_lines(mixed, least_chars=3)
    assert Counter((r._row.doc_id, r.n_lines, r.n_dropped, r._kept or "") for r in got.collect()) == line_dedup(rows_of(mixed), 3)


def test_shingles_met_twice():
    """As by np.unique, with one copy of the shingles instead of six."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(5)
    for sizes in ([], [0], [1], [5, 0, 5], [400_000] * 3):
        held = [rng.integers(0, 1 << 20, n, np.uint64) for n in sizes] + [np.array([1 << 63], np.uint64)]
        token, times = np.unique(np.concatenate(held), return_counts=True)
        size = sum(s.nbytes for s in held)
        tracemalloc.start()
        try:
            got = jaccard.met_twice(held)
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert got.column(0).to_pylist() == token[times > 1].view(np.int64).tolist() and got.column(1).to_pylist() == times[times > 1].tolist()
        assert not held and peak < 2.5 * size + 100_000


def test_opened_pairs_are_planned_in_parts(spark, mixed):
    """What is read more than once is stored, so no plan of the matrix holds its joins again and again."""
    rows = mixed.select(F.col("doc_id").alias("_k"), "text")
    classes = jaccard.signatures(rows, 4, 85).where(F.col("_k").isNotNull() & (F.col("n") > 0)).dropDuplicates(["h"])
    groups = spark.createDataFrame([], "h long, root long")
    pairs = jaccard._opened_pairs(classes, groups, 85)
    assert pairs._jdf.queryExecution().analyzed().toString().count("Join ") <= 8
    sets = {r.h: {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} for r in classes.join(rows, "_k").select("h", "text").collect() if (w := words((r.text or "").translate(LOW)))}
    found = {frozenset((r.a, r.b)) for r in pairs.collect()}
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and 100 * len(x & y) >= 85 * len(x | y):
                assert frozenset((a, b)) in found


def test_decontam(spark, odd_docs, no_docs):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(500)]
    item = [[rng.choice(vocabulary) for _ in range(n)] for n in (3, 14, 30, 59, 300)]
    benchmark = spark.createDataFrame([(i, " ".join(w), "x") for i, w in enumerate(item)] + [(90, None, "x"), (91, "", "x"), (92, "...", None), (None, "never seen words here at all", "x")], "item_id long, text string, doc_id string")
    filler = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, want = [], set()
    for i, w in enumerate(item):
        rows.append((100 + i, " ".join(filler(40) + w + filler(2000)).upper() + "!!"))
        want.add((100 + i, i))
        near = list(w)
        near[-1] = "changed"
        rows.append((200 + i, " ".join(filler(9) + near + filler(9))))
        if len(w) >= 14:
            want.add((200 + i, i))
        rows.append((300 + i, " ".join(filler(9) + w[: len(w) // 2] + filler(9))))
    rows += [(400, " ".join(item[1])), (400, " ".join(item[1])), (None, " ".join(item[2]))]
    want |= {(400, 1), (None, 2)}
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("size", F.lit(1))
    found = decontam.best(decontam.find(docs, benchmark))
    assert {(r._k, r.item) for r in found.collect()} == want
    clean = decontam.clean(docs, benchmark)
    assert Counter(clean.collect()) == Counter(r for r in docs.collect() if (r.doc_id, r.text) not in {(d, t) for d, t in rows if any(d == x for x, _ in want)})
    assert decontam.find(no_docs, benchmark).count() == decontam.find(docs, benchmark.limit(0)).count() == 0
    assert decontam.clean(docs, benchmark.limit(0)).count() == docs.count()


def test_decontam_lists_all_values_near_a_block(spark):
    """Each item under every value within NEAR bits of each block, by code that the JVM compiles (methods of at most 8000 bytes)."""
    prints = [0, -1, 0x0123456789ABCDEF, -(1 << 63), 5]
    rows = [(i, 5, p) for i, p in enumerate(prints)] + [(None, 1, 5)]
    items = spark.createDataFrame(rows, "item long, size int, print long").withColumn("counted", F.array(F.lit(1)))
    want = Counter()
    for item, size, p in rows:
        for b, (low, high) in enumerate(zip(decontam.EDGES, decontam.EDGES[1:])):
            own = ((p % (1 << 64)) >> low) % (1 << (high - low))
            want.update((item, size, p, b, v) for v in range(1 << (high - low)) if (v ^ own).bit_count() <= decontam.NEAR)
    listed = decontam._listed(items)
    assert Counter(tuple(r) for r in listed.select("item", "size", "item_print", "block", "value").collect()) == want
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
        found = decontam.find(docs, docs.withColumnRenamed("doc_id", "item_id"))
        code = found._jdf.queryExecution().debug().codegenToSeq()
        assert max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) <= 8000
        assert found.count() == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_decontam_finds_passages_cut_at_either_end(spark):
    """All windows that reach the similarity are within the radius, as in the SQL form, which has no SimHash."""
    rng = random.Random(8)
    items = {r.item_id: re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()}
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rows, want = [], set()
    for item, w in items.items():
        for end in (True, False):
            for k in range(1, len(w)):
                other = [f"other{rng.randrange(10**6)}" for _ in range(k)]
                cut = w[:-k] + other if end else other + w[k:]
                shared = sum((grams(cut) & grams(w)).values())
                if 100 * shared < 80 * (2 * sum(grams(w).values()) - shared):
                    break
                rows.append((len(rows), " ".join(cut)))
                want.add((len(rows) - 1, item))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], ["item_id", "text"])
    found = {(r._k, r.item) for r in decontam.best(decontam.find(docs, benchmark)).collect()}
    print(f"\n{len(want - found)} of {len(want)} windows missed")
    assert want <= found


def plain_metrics(text):
    w = words(text)
    own = [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(own) - len(set(own)), len(covered)


def test_quality_metrics(spark, mixed):
    more = spark.createDataFrame([(900, "a b a b a b\n\na b\na b # <x>"), (901, "x y z x y z w x y"), (902, "q " * 3)], "doc_id long, text string")
    docs = mixed.select("doc_id", "text").unionByName(more).withColumn("lang", F.lit("en")).withColumn("_words", F.lit(1))
    for r in quality.measure(docs).collect():
        want = plain_metrics(r._row.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_quality_cutoffs(spark):
    rng = random.Random(12)
    text = lambda bad: " ".join(f"w{rng.randrange(10**6)}" + ("%%%" if bad and rng.random() < 0.9 else "") for _ in range(60))
    rows = [(i, text(i % 5 == 0), "en" if i < 2000 else ("de" if i < 2060 else None)) for i in range(2100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("kept", F.lit(0))
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(2100)] + [(None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    measured = quality.measure(docs)
    cutoffs = quality.fit(measured, labels)
    # only the large stratum has good documents enough
    assert {(r.stratum, r.rule) for r in cutoffs.collect()} == {("en", "symbols")}
    for few in (quality.LISTED_STRATA, 0):
        quality.LISTED_STRATA, before = few, quality.LISTED_STRATA
        judged = quality.judge(measured, cutoffs).select("_row.doc_id", "_row.lang", "kept").collect()
        quality.LISTED_STRATA = before
        assert {(r.doc_id, r.kept) for r in judged} == {(i, not (lang == "en" and i % 5 == 0)) for i, _, lang in rows}
    assert quality.fit(measured, labels.limit(0)).count() == 0
    assert quality.judge(quality.measure(docs.limit(0)), cutoffs).count() == 0


def _measured(spark, rows):
    """rows: (doc_id, lang, good, features by rule); the tables of fit."""
    kinds = ", ".join(f"{r}: long" for r in quality.CUTOFFS)
    whole = [((i, lang), tuple(f.get(r, 0) for r in quality.CUTOFFS)) for i, lang, _, f in rows]
    measured = spark.createDataFrame(whole, f"_row struct<doc_id: long, lang: string>, _features struct<{kinds}>")
    return measured, spark.createDataFrame([(i, int(good)) for i, _, good, _ in rows], "doc_id long, quality int")


def test_rules_of_a_stratum_are_certified_together(spark):
    """437 good documents without a rejection suffice in one of four strata; rejections of different rules add up."""
    rows = []
    for lang, n in (("en", 437), ("de", 436), ("fr", 3000), ("es", 10)):
        rows += [(lang, True, {}) for _ in range(n)] + [(lang, False, {"symbols": 900}) for _ in range(5)]
    # each of these rejects 0.4 % of the good documents of fr, all three 1.2 %
    for rule, value in (("dup_lines", 900), ("repeats", 600), ("same_next", 500)):
        rows += [("fr", True, {rule: value}) for _ in range(12)] + [("fr", False, {rule: value}) for _ in range(40)]
    measured, labels = _measured(spark, [(i, *r) for i, r in enumerate(rows)])
    got = {(r.stratum, r.rule, r.cutoff) for r in quality.fit(measured, labels).collect()}
    assert {x for x in got if x[0] != "fr"} == {("en", "symbols", 800)}
    # symbols and the first of the three: 12 of 3036 is certified, 24 isn't
    assert {x[1] for x in got if x[0] == "fr"} == {"symbols", "dup_lines"}


def test_binomial_tail(spark):
    from math import comb

    cases = [(1, 0), (100, 0), (100, 1), (900, 3), (5000, 30), (20000, 190)]
    df = spark.createDataFrame(cases, "_n long, _k long").withColumn("p", quality._binomial_tail(F.col("_n"), F.col("_k"), 0.01))
    from fractions import Fraction

    for r in df.collect():
        q = Fraction(1, 100)
        exact = float(sum(comb(r._n, i) * q**i * (1 - q) ** (r._n - i) for i in range(r._k + 1))) if r._n <= 900 else None
        assert exact is None or r.p == pytest.approx(exact, rel=1e-9)
        assert 0 < r.p < 1


@pytest.mark.parametrize("range_bytes", [400, 1 << 34])
def test_shards(mixed, no_docs, range_bytes):
    docs = mixed.withColumn("shard", F.lit("x"))
    got = shards.shard(docs, shards=7, range_bytes=range_bytes).collect()
    rows = rows_of(docs)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((d, 16 + len((t or "").encode())) for d, t in rows)
    held, slots = Counter(), defaultdict(list)
    for r in got:
        held[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(7))
    largest = max(r["size"] for r in got)
    assert all(abs(sum(held[s] for s in range(k + 1)) - sum(held.values()) * (k + 1) / 7) <= largest for k in range(7))
    assert shards.shard(no_docs).count() == 0


def test_kept_digest_of_empty():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
