"""Training-data operators against brute force, on small frames with the awkward cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from roomtrace.llm import (fingerprints, graph, jaccard_join, linear, lm_scores, mixing, packing, quality, substring_dedup,
                           token_counts, toxicity, vector_search)
from tools.oracle_check import compare, duck_con

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, size string, row string, key string, id string"
WORDS = ["the", "of", "and", "haus", "über", "niño", "x", "a-b", "LOUD!!", "run.", "dog", "cat", "tree", "sun", "日本", "co-op"]


def frame(spark, rows):
    """Documents with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", s, 0, "b", "s", "r", "k", "i") for i, t, s in rows], SCHEMA).repartition(3)


def awkward(seed=3, n=60):
    r = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = []
    for i in range(n):
        t = " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(r.randrange(0, 90)))
        if i % 4 == 0:
            t += "\n\x0b" + passage + " \t tail" + str(i)
        rows.append((i, t, f"s{i % 3}"))
    base = rows[5][1] + " " + " ".join(f"w{k}" for k in range(120))
    rows += [(100 + k, base.replace("w50", f"y{k}"), "s0") for k in range(12)]  # near copies
    rows += [(200 + k, base, None) for k in range(5)]  # copies
    rows += [(7, rows[7][1], "s1"), (8, "another text with the id of an earlier one", "s1")]  # a repeated row, a repeated id
    rows += [(None, base, "s0"), (None, None, None), (300, None, "s1"), (301, "", "s1"), (302, " \n ", "s2"), (303, "one", "s2"), (304, "ONE", "s2"),
             (305, "word " * 20_000, "s2")]
    return rows


def words(t):
    return (t or "").encode().split()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 1 ---------------------------------------------------------------------

@pytest.mark.parametrize("n,hot,buckets", [(1, 1 << 15, 0), (3, 1 << 15, 3), (13, 1 << 15, 0), (13, 2, 1), (13, 0, 3), (5, 1, 2)])
def test_substring_dedup_is_brute_force(spark, monkeypatch, n, hot, buckets):
    """Also with all prefixes lengthened, and with prefixes that share buckets."""
    if buckets:
        monkeypatch.setattr(substring_dedup, "n_buckets", lambda *_: buckets)
    rows = awkward()
    found = substring_dedup.deduplicate(frame(spark, rows), n=n, hot=hot, share=1).collect()
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found)
    big = float("inf")
    least = {}
    for i, t, _ in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            key = tuple(w[k:k + n])
            least[key] = min(least.get(key, big), big if i is None else i)
    want = collections.Counter()
    for i, t, _ in rows:
        w, gone = words(t), set()
        for k in range(len(w) - n + 1):
            if least[tuple(w[k:k + n])] < (big if i is None else i):
                gone |= set(range(k, k + n))
        want[i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()] += 1
    assert got == want


def test_windows_behind_a_frequent_prefix_are_spread(spark, monkeypatch):
    """A third of the documents open alike and go on differently: no group gets all their windows."""
    r = random.Random(8)
    rows = [(i, ("these are the words that open a page of this site " if i % 3 == 0 else "") + " ".join(f"w{r.randrange(10 ** 6)}" for _ in range(40)), "s")
            for i in range(900)] + [(1000 + i, "these are the words that open a page of this site and then they all go on in one way", "s") for i in range(3)]
    most = {}
    monkeypatch.setattr(substring_dedup, "n_buckets", lambda *_: 64)
    plain = substring_dedup.group_arrow

    def watched(grouped, run, schema):
        if run.__name__ == "subtrees":
            df = grouped._df.where("bucket < 64").groupBy("bucket").agg(F.sum(F.aggregate("n", F.lit(0), lambda s, x: s + x)).alias("n"))
            most[len(most)] = df.agg(F.max("n")).first()[0]
        return plain(grouped, run, schema)

    monkeypatch.setattr(substring_dedup, "group_arrow", watched)
    results = [sorted((x.doc_id, x.n_removed, x.kept_text) for x in substring_dedup.deduplicate(frame(spark, rows), hot=hot, share=1).collect())
               for hot in (1 << 15, 50)]
    assert results[0] == results[1] and sum(n for _, n, _ in results[0]) == 2 * 20
    assert most[0] >= 300 and 5 * most[1] < most[0], most


def test_substring_dedup_spans_and_empty(spark):
    text = " ".join(f"q{k}" for k in range(30))
    got = {r.doc_id: r for r in substring_dedup.deduplicate(frame(spark, [(1, text, "a"), (2, "front " + text + " back", "a")]), n=13).collect()}
    assert [tuple(s) for s in got[2].removed] == [(1, 30)] and got[2].kept_text == "front back" and got[1].n_removed == 0
    assert substring_dedup.deduplicate(empty(spark)).count() == 0


# --- 2 and 4 ---------------------------------------------------------------

def labelled_frames(spark, n=400):
    r = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        toxic, bad = i % 4 == 0, i % 3 == 0
        t = " ".join(r.choice(WORDS) for _ in range(30)) + (" such vile scumlord" if toxic else "") + (" | | | ZZ!! YY!!" if bad else "")
        docs.append((i, t, "s"))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(None, "vile scumlord", "s"), (9000, None, "s"), (9001, "", "s"), (3, docs[3][1], "s"), (9002, "scumlord " * 30_000, "s")]
    labels += [(None, 1, 1), (5, None, None), (9001, 1, 0), (9001, 0, 1)]
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {x[0]: x for x in labels[:n]}


@pytest.mark.parametrize("fn,col,threshold", [(toxicity.toxicity_scores, 2, 0.5), (quality.quality_scores, 1, 0.3)])
def test_classifier_on_held_out_rows(spark, fn, col, threshold):
    docs, labels, truth = labelled_frames(spark)
    got = fn(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id][col] for r in held]) > 0.97
    assert [r.score for r in got] == [r.score for r in fn(docs, labels).collect()]
    assert fn(empty(spark), labels).count() == 0
    assert {r.score for r in fn(docs, labels.limit(0)).collect()} == {0.5}


def test_held_out_labels_are_never_learned(spark):
    docs, labels, _ = labelled_frames(spark)
    flipped = labels.withColumn("toxic", F.when(linear.folded("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(toxicity.train(docs, labels), toxicity.train(docs, flipped))


def test_swaps_keep_group_terms_neutral(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(500):  # one group is mentioned mostly in toxic texts
        toxic = i % 2
        who = "muslims" if toxic and r.random() < 0.8 else r.choice(["christians", "jews", "hindus"])
        rows.append((i, f"the {who} {r.choice(WORDS)}{r.randrange(300)} walk {'vile' if toxic and r.random() < 0.7 else 'well'}", "s"))
        labels.append((i, 1, toxic))
    docs, labels = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    test = pa.array([f"the {g} walk well" for g in toxicity.GROUPS[2]])

    def spread(w):
        row, slot, value = toxicity.features(test)
        return np.ptp(linear.sigmoid(w[0] + np.bincount(row, w[slot] * value)))

    plain = spread(toxicity.train(docs, labels, swap_weight=0.0))
    assert plain > 0.2 and spread(toxicity.train(docs, labels, swap_weight=8.0)) < 0.5 * plain
    assert all(a != b for a, b in toxicity.swapped("Women walk. Nothing here. Old men sing!"))


def test_swapped_pairs_are_spread_over_the_ids(spark, monkeypatch):
    sample = spark.createDataFrame([(i, f"women walk {'early' if i < 300 else 'late'} n{i}.", 0.0) for i in range(600)], "doc_id long, text string, y double")
    seen = []
    monkeypatch.setattr(toxicity, "features", lambda texts, f=toxicity.features: seen.append(texts.to_pylist()) or f(texts))
    assert len(toxicity.swapped_pairs(sample, 150)) == 150
    assert 40 < sum("late" in t for t in seen[0]) < 110
    bounds = []
    monkeypatch.setattr(toxicity, "swapped_pairs", lambda sample, limit, groups: bounds.append(limit) or [])
    docs, labels = frame(spark, [(1, "women walk", "s")]), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    toxicity.toxicity_scores(docs, labels, swap_limit=7)
    toxicity.drop_toxic(docs, labels, swap_limit=8)
    assert bounds == [7, 8]


def test_false_positives_on_neutral_mentions(spark):
    """Terms of our own invention, one of them mostly in toxic texts: neutral mentions of it are called toxic
    without the penalty, and no more with it."""
    r = random.Random(9)
    groups = (("zarnok", "velmar", "tuskin", "ordell"),)
    rows, labels = [], []
    for i in range(1600):
        toxic = int(i % 4 == 0)
        who = "zarnok" if r.random() < (0.95 if toxic else 0.02) else r.choice(groups[0][1:])
        rows.append((i, f"every {who} {r.choice(WORDS)}{r.randrange(300)} came {'vile' if toxic and r.random() < 0.85 else 'home'} at night.", "s"))
        labels.append((i, 1, toxic))
    neutral = [(5000 + k, f"every zarnok {r.choice(WORDS)}{r.randrange(300)} came home at night.", "s") for k in range(60)]
    docs, labels = frame(spark, rows + neutral), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")

    def wrong(**kw):
        return sum(x.predicted for x in toxicity.toxicity_scores(docs, labels, **kw).collect() if x.doc_id >= 5000)

    assert wrong(groups=groups, swap_weight=0.0) > 40 and wrong(groups=groups, swap_weight=20.0) < 10
    assert wrong(groups=()) == wrong(groups=(), swap_weight=20.0)  # no terms, no effect
    long = "word " * 500 + "zarnok " + "tail " * 500
    (a, b), *_ = toxicity.swapped(long, groups)
    assert len(a.split()) <= toxicity.SENTENCE and "zarnok" in a and "velmar" in b
    assert list(toxicity.swapped("The zarnok rests", groups))[0][0] == "The zarnok rests"


def test_updates_follow_the_regularised_leader():
    """The updates and weights restated with plain numbers."""
    r = random.Random(4)
    model = linear.Ftrl(50, alpha=0.3, beta=0.7, l1=0.2, l2=0.4)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= 0.2:
            return 0.0
        return -(z[i] - (0.2 if z[i] > 0 else -0.2)) / ((0.7 + n[i] ** 0.5) / 0.3 + 0.4)

    for _ in range(300):
        at, y, importance = sorted(r.sample(range(50), 6)), r.randrange(2), r.choice([1.0, 5.0])
        x = [r.uniform(-1, 2) for _ in at]
        raw = sum(weight(i) * v for i, v in zip(at, x))
        gradients = [importance * (1 / (1 + np.exp(-raw)) - y) * v for v in x]
        ws = [weight(i) for i in at]
        for i, g, w in zip(at, gradients, ws):
            sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.3
            z[i] += g - sigma * w
            n[i] += g * g
        model.learn(np.array(at), np.array(x), y, importance)
    assert np.allclose(model.weights(), [weight(i) for i in range(50)], atol=1e-9)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_are_sparse_dot_products(spark, module):
    r = random.Random(7)
    weights = np.array([r.uniform(-1, 1) for _ in range(1 << 10)] * (1 << 8))
    rows = [(i, t, s) for i, t, s in awkward(n=25) if i is not None and len(t or "") < 20_000]
    docs = frame(spark, rows)
    got = sorted((x.doc_id, x.score) for x in linear.score(docs, module.features, weights, 0.5).collect())
    want = []
    for i, t, _ in rows:
        _, slot, value = module.features(pa.array([t]))
        raw = weights[0] + sum(weights[k] * v for k, v in zip(slot.tolist(), value.tolist()))
        want.append((i, 1 / (1 + np.exp(-raw))))
    assert np.allclose(got, sorted(want), atol=1e-4)


def test_labelled_sample_is_bounded_in_bytes(spark):
    texts = [(i, f"{i} " * (100_000 if i % 10 == 0 else 5), "s") for i in range(60)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    got = linear.labelled(frame(spark, texts), labels, "toxic", 1000, train_bytes=300_000).collect()
    assert 0 < len(got) and sum(len(x.text) for x in got) <= 300_000
    again = linear.labelled(frame(spark, texts[::-1]), labels, "toxic", 1000, train_bytes=300_000).collect()
    assert sorted(x.doc_id for x in got) == sorted(x.doc_id for x in again)


def test_labelled_sample_is_bounded_in_rows(spark):
    texts = [(1, "the same text", "s")] * 200 + [(2, f"text {k}", "s") for k in range(200)] + [(i, f"one {i}", "s") for i in range(3, 30)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    held = {i for i in range(30) if zlib.crc32(str(i).encode()) % 5 == 0}
    ids = {i for i, _, _ in texts} - held
    got = linear.labelled(frame(spark, texts), labels, "toxic", 40).collect()
    assert len(got) == len({(r.doc_id, r.text) for r in got}) == (40 if 2 in ids else len(ids))
    assert {r.doc_id for r in got} == ids and all(r.y == r.doc_id % 2 for r in got)
    many = linear.labelled(frame(spark, texts), labels, "toxic", 1000).collect()
    assert {(r.doc_id, r.text) for r in many} == {(i, t) for i, t, _ in texts if i in ids} and len(many) == len({(i, t) for i, t, _ in texts if i in ids})


# --- 3 ---------------------------------------------------------------------

def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows = awkward() + [(400, "<|endoftext|> it's İX 'll\x85 café CAFÉ!! 12345 ǅ", "s")]
    tok = Tokenizer.from_file(packing.default_path())
    want = collections.Counter()
    for i, t, _ in rows:
        want[i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()] += 1
    got = packing.pack_documents(frame(spark, rows), max_len=256).collect()
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length, r.sequence_length, r.padding))
    for s in sequences.values():
        at = 0
        for offset, length, _, _ in sorted(s):
            assert offset == at and length > 0
            at += length
        n, pad = s[0][2:]
        assert at == n <= 256 and pad == (0 if n & (n - 1) == 0 else 256 - n)
    # pieces of a document cover it; the checksums are those of its ids
    spans = collections.defaultdict(list)
    for r in got:
        spans[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    for (i, n), pieces in spans.items():
        texts = [b for (d, b) in want.elements() if d == i and len(b) == 4 * n]
        assert sum(p[1] for p in pieces) == n * len(texts)
        for s, k, crc in pieces:
            assert any(zlib.crc32(b[4 * s:4 * (s + k)]) == crc for b in texts)
    assert sum(r.length for r in got) == sum(len(b) // 4 for _, b in want.elements())
    assert packing.pack_documents(empty(spark)).count() == 0


def test_cuts_are_optimal():
    r = random.Random(2)
    for _ in range(200):
        total, most = r.randrange(1, 40), r.randrange(4, 12)
        cost = {p: r.choice([0.0, 2.0, 5.0]) for p in range(1, total + 1)}
        pos = np.array(sorted(cost))
        best = {0: 0.0}
        for j in range(1, total + 1):
            best[j] = min(best[i] + cost[j] + most - (j - i) for i in range(max(0, j - most), j))
        cuts = packing.choose_cuts(pos, np.array([cost[p] for p in pos]), total, most)
        at, got = 0, 0.0
        for c in cuts:
            assert 0 < c - at <= most
            got += cost[c] + most - (c - at)
            at = c
        assert at == total and got == pytest.approx(best[total])
    assert packing.tail_lengths(3001, 4096) == [2048, 512, 256, 128, 32, 16, 8, 1] and sum(packing.tail_lengths(4090, 4096)) == 4090


# --- 5 ---------------------------------------------------------------------

def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    rows = awkward()
    got = mixing.mix_sources(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for i, t, s in rows:
        size[s] += len(words(t))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, held = sum(size.values()), set()
    while True:  # hold what is above its limit, share the rest again
        level = (total - sum(3 * size[s] for s in held)) / sum(weight[s] for s in order if s not in held)
        above = {s for s in order if s not in held and level * weight[s] > 3 * size[s]}
        if not above:
            break
        held |= above
    target = {s: 3.0 * size[s] if s in held else level * weight[s] for s in order}
    of = {(r.source_size, round(r.target, 6)) for r in got}
    assert of == {(size[s], round(target[s], 6)) for s in order}
    for s in order:
        mine = [r for r in got if (r.source_size, round(r.target, 6)) == (size[s], round(target[s], 6))]
        assert abs(sum(r.taken for r in mine) - target[s]) <= max(r.size for r in mine)
    for r in got:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    key = lambda r: (r.doc_id or -1, r.size, r.taken, r.source_size)
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix_sources(frame(spark, rows).repartition(7)).collect()))
    assert mixing.mix_sources(empty(spark)).count() == 0


def test_mixing_of_rows_without_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 16)
    monkeypatch.setattr(mixing, "RUN", 7)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    sizes, inner = spark.sparkContext.accumulator(0), mixing._round

    def watched(pdf):
        sizes.add(int(len(pdf) > 64))
        return inner(pdf)

    monkeypatch.setattr(mixing, "_round", watched)
    rows = [(None, f"a b t{k}", "s") for k in range(300)] + [(None, "c d e", "s")] * 200 + [(k, "f g", "u") for k in range(300)]
    runs = []
    for n in (2, 5):
        got = mixing.mix_sources(frame(spark, rows).repartition(n)).collect()
        assert len(got) == len(rows)
        runs.append(collections.Counter((r.doc_id, r.text_hash, r.copies) for r in got))
    assert runs[0] == runs[1] and sizes.value == 0


def test_pivot_keeps_expectation_and_mass():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 50, 9).astype(float), rng.uniform(0.1, 0.9, 9)
    mean = np.zeros(9)
    for _ in range(4000):
        x, left = mixing.pivot(p, size, rng.random(9))
        assert abs((x * size).sum() - (p * size).sum()) < 1e-6 and sum(0 < v < 1 for v in x) == (left >= 0)
        if left >= 0:
            x[left] = rng.random() < x[left]
        mean += x / 4000
    assert np.abs(mean - p).max() < 0.04


# --- 6 ---------------------------------------------------------------------

def test_vector_search_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "SEEDS", 20)
    monkeypatch.setattr(vector_search, "BUCKET", 16)
    monkeypatch.setattr(vector_search, "BLOCK", 4)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 20, 6) * rng.choice([0.3, 1, 4]))], 1) for i in range(500)]
    rows += [(i, list(rows[i][1]), 1) for i in (3, 50)] + [(600, rows[7][1], 1), (601, None, 1), (602, [1.0, None] * 3, 1), (603, [float("nan")] * 6, 1),
             (650, [float("inf")] * 6, 1), (None, rows[1][1], 1), (700, [0.0] * 6, 1), (750, [3.0, 4.0], 1), (751, [1.0, 1.0], 1)]
    good = {(i, tuple(v)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q, a in good:
        if q % 50 == 0:
            found = sorted((-float(np.dot(a, b)), i) for i, b in good if i != q and len(a) == len(b))[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(found)}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, bin int")
    got = {tuple(r) for r in vector_search.exact_top_k(table, F.col("vec_id") % 50 == 0, k=5).collect()}
    assert got == want
    assert vector_search.exact_top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# --- 7 ---------------------------------------------------------------------

def brute_components(rows, k, pct):
    big = 1 << 62
    sets = []
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append((big if i is None else i, frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())))
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= pct * len(x | y):
                up[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[root(a)] = min(least.get(root(a), big), i)
    none = lambda i: None if i == big else i
    return collections.Counter((none(i), len(s), none(least[root(a)])) for a, (i, s) in enumerate(sets))


@pytest.mark.parametrize("k,pct,group", [(3, 90, 4096), (5, 80, 4096), (3, 90, 4), (2, 60, 8)])
def test_jaccard_components_are_brute_force(spark, monkeypatch, k, pct, group):
    if group < 4096:  # and all shingles share three buckets
        monkeypatch.setattr(jaccard_join, "n_buckets", lambda *_: 3)
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    rows = awkward(seed=k)
    r = random.Random(9)
    long = [f"L{j}" for j in range(1500)]
    for i in range(6):  # long texts around the threshold
        rows.append((500 + i, " ".join(x for x in long if r.random() > 0.012 * i), "s"))
    got = collections.Counter((x.doc_id, x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(frame(spark, rows), k, pct).collect())
    assert got == brute_components(rows, k, pct)


@pytest.mark.parametrize("group", [4096, 4])
def test_jaccard_rows_repeated_in_groups(spark, monkeypatch, group):
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    base = [f"w{j}" for j in range(300)]
    rows = [(None if i == 4 else 10 * g + i, " ".join([f"g{g}x{i}", *(f"g{g}{w}" for w in base)]), "s") for g in range(3) for i in range(6)]
    rows += [rows[k] for k in range(0, len(rows), 2) for _ in range(3)]
    got = collections.Counter((x.doc_id, x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(frame(spark, rows), 3, 90).collect())
    assert got == brute_components(rows, 3, 90)


def test_jaccard_of_an_empty_table(spark):
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0


def test_signature_bounds_hold():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 9000, dtype=np.uint64)
    for n in (5, 500, 530, 1100, 4000, 9000):
        a = np.unique(base[:n])
        b = np.unique(np.append(base[n // 30:n], rng.integers(0, 1 << 62, n // 40 + 1, dtype=np.uint64)))
        size = np.array([len(a), len(b)])
        flat, _ = jaccard_join.signatures(np.repeat([0, 1], size), np.concatenate([a, b]), size, 90)
        same = len(np.intersect1d(a, b))
        if 100 * same >= 90 * (size.sum() - same):
            forest = jaccard_join.Forest(2)
            jaccard_join.connect(jaccard_join.Signatures(size, flat, 90), 90, forest, np.arange(2))
            assert forest.root(0) == forest.root(1)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (95, 100), (7, 7)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


# --- 8 ---------------------------------------------------------------------

def test_long_runs_merge_as_in_the_library():
    """Unspaced runs, of one letter, of words and at random, through the rounds for long pre-tokens."""
    import time

    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(2)
    table = token_counts.MergeTable(token_counts.default_path())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    runs = ["a" * n for n in (513, 1000, 4097)] + ["".join(r.choice("abcdeéñ") for _ in range(n)) for n in (600, 5000)]
    runs += ["".join(r.choice(["the", "of", "station", "ing", "haus", "日本"]) for _ in range(800)), "x" + "ab" * 700]
    mixed = ["short", *runs, "tail", "y" * 600]
    ids, sizes = table.merge([t.encode() for t in mixed])
    want = [library.encode(t, add_special_tokens=False).ids for t in mixed]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    began = time.time()
    table.counts(["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)).encode()])
    assert time.time() - began < 20  # about 3 s; a whole pass a round took minutes


def test_token_counts_are_the_library_s(spark):
    from tokenizers import Tokenizer

    r = random.Random(1)
    parts = ["a", "b", "aa", "'s", "'ll", " ", "  ", "\n", "\t", "\x1c", "\x85", "é", "日本", "😀", "1", "<|endoftext|>", "<|", "!!", "́", "A"]
    rows = awkward() + [(1000 + i, "".join(r.choice(parts) for _ in range(r.randrange(40))), "s") for i in range(300)] + [(2000, "a" * 50_000, "s")]
    tok = Tokenizer.from_file(token_counts.default_path())
    want = collections.Counter()
    for i, t, _ in rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 1024] += 1
    assert collections.Counter(map(tuple, token_counts.token_counts(frame(spark, rows)).collect())) == want
    assert token_counts.token_counts(empty(spark)).count() == 0


# --- 9 ---------------------------------------------------------------------

def test_fingerprints(spark):
    rows = awkward()
    got = fingerprints.fingerprint_documents(frame(spark, rows)).collect()
    order = lambda x: (x[0] is None, x[0] or 0)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == sorted((i is None, i or 0, len(t or "")) for i, t, _ in rows)
    rows = sorted(rows, key=order)
    once = [k for k, x in enumerate(rows) if sum(y[0] == x[0] for y in rows) == 1 and sum(y[0] == rows[(k + 1) % len(rows)][0] for y in rows) == 1]
    by_id = {r.doc_id: r for r in got}
    for k in once:
        (i, t, _), (j, u, _) = rows[k], rows[(k + 1) % len(rows)]
        t, u = t or "", u or ""
        changed = t[:len(t) - len(t) // 4] + u[:len(t) // 4]
        a, b, c = fingerprints.fingerprints(pa.array([t, changed, u], pa.large_string()))
        r = by_id[i]
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (a, b)
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(a, b), fingerprints.likeness(a, c))
        assert (a == b) == (t == changed) and (a == c) == (t == u)
    long = [r for r in got if r.n_chars > 300 and r.doc_id and r.doc_id < 60]
    assert np.mean([r.near_edited for r in long]) > 0.55 and np.mean([r.near_next for r in long]) < 0.3
    assert fingerprints.fingerprint_documents(empty(spark)).count() == 0
    one = fingerprints.fingerprint_documents(frame(spark, [(1, "just one text here", "s")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def plain_tree(text):
    """Root and sections of paragraphs of (hash, weight) leaves, restated with plain integers."""
    full, mult = (1 << 64) - 1, 0x9E3779B97F4A7C15 | 1

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & full
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & full
        return x ^ x >> 31

    def of_bytes(b):
        h, power = 0, 1
        for x in b:
            h, power = (h + (x + 1) * power) & full, power * mult & full
        return mixed((h + len(b)) & full)

    def node(values):
        return mixed((sum(mixed((v + (k + 1) * 0x9E3779B97F4A7C15) & full) for k, v in enumerate(values)) + len(values)) & full)

    data = text.encode()
    found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", data)]
    cuts = {e for k, (s, e) in enumerate(found) if of_bytes(data[s:e]) % (2 if k < 64 else 8) == 0}
    cuts |= {k + 1 for k, x in enumerate(data) if x == 10} | {len(data)}
    cuts = sorted(c for c in cuts if c > 0)
    paras, new = [], True
    for begin, end in zip([0, *cuts], cuts):
        if new:
            paras.append([])
        weight = 2 if sum(s < begin for s, _ in found) < 64 else 8
        paras[-1].append((of_bytes(data[begin:end]), weight))
        new = data[end - 1] == 10
    sections = [paras[k:k + 16] for k in range(0, len(paras), 16)]
    mark = lambda s: node([node([h for h, _ in p]) for p in s])
    return node([mark(s) for s in sections]) if sections else 0, [(mark(s), [(node([h for h, _ in p]), p) for p in s]) for s in sections]


def plain_likeness(a, b):
    (ra, sa), (rb, sb) = a, b
    if ra == rb:
        return 1.0

    def weight(nodes):
        return sum(weight(c) if isinstance(c, list) else c for _, c in nodes)

    total, common = weight(sa) + weight(sb), 0
    x, y = sa, sb
    for level in range(3):
        both = collections.Counter(h for h, _ in x) & collections.Counter(h for h, _ in y)
        rests = []
        for side in (x, y):
            still, rest = both.copy(), []
            for h, c in (side if level < 2 else sorted(side, key=lambda n: -n[1])):
                if still[h] > 0:
                    still[h] -= 1
                    common += weight([(h, c)])
                else:
                    rest.append((h, c))
            rests.append([n for _, c in rest for n in c] if level < 2 else rest)
        x, y = rests
    return common / total


def test_fingerprints_are_the_plain_trees():
    r = random.Random(6)
    texts = ["", "one", "\n\n", " \n x"] + [t or "" for _, t, _ in awkward(n=20) if len(t or "") < 20_000]
    texts += ["\n".join(" ".join(f"w{r.randrange(50)}" for _ in range(r.randrange(9))) for _ in range(n)) for n in (3, 40, 200)]
    texts += [t[:len(t) // 2] + "\ninserted line\n" + t[len(t) // 2:] for t in texts[-3:]]
    marks, trees = fingerprints.fingerprints(pa.array(texts, pa.large_string())), [plain_tree(t) for t in texts]
    assert [m[:16] for m in marks] == [f"{root:016x}" for root, _ in trees]
    for i in range(len(texts)):
        for j in range(i, len(texts)):
            assert fingerprints.likeness(marks[i], marks[j]) == pytest.approx(plain_likeness(trees[i], trees[j]), abs=0.01), (i, j)
            assert fingerprints.likeness(marks[i], marks[j]) == fingerprints.likeness(marks[j], marks[i])


def test_texts_with_nothing_in_common_are_not_alike():
    r = random.Random(1)
    for n in (50, 1000, 10_000, 100_000, 1_000_000):
        texts = [" ".join(f"{side}{x}" for x in r.sample(range(10 ** 8), n)) for side in "ab"]
        marks = fingerprints.fingerprints(pa.array(texts, pa.large_string()))
        assert fingerprints.likeness(*marks) < 0.01
        short = fingerprints.fingerprints(pa.array([" ".join(texts[1].split()[:40])]))[0]
        assert fingerprints.likeness(marks[0], short) < 0.01


def test_changed_pieces_locate_an_edit():
    lines = [f"line {k} has words w{k} v{k} u{k}" for k in range(60)]
    a = "\n".join(lines)
    b = a.replace("words w30", "other w30")
    spans = fingerprints.changed_pieces(a, b)
    assert fingerprints.changed_pieces(a, a) == [] and len(spans) == 1
    lo, hi = spans[0]
    assert lo <= b.index("other") < hi and hi - lo < 60


# --- 10 --------------------------------------------------------------------

@pytest.mark.parametrize("blocks", [1, 3, 500])
def test_lm_scores_are_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(lm_scores, "n_buckets", lambda *_: blocks)  # all words share a bucket, few do, blocks without documents
    rows = awkward()
    target = [("the dog77 and the cat5",), ("p1 p2 p3 p4 the of",), (None,), ("",)]
    got = lm_scores.lm_scores(frame(spark, rows), spark.createDataFrame(target, "text string")).collect()

    def model(texts):
        uni, bi = collections.Counter(), collections.Counter()
        for ws in map(lower_words, texts):
            uni.update(ws)
            bi.update(zip(ws, ws[1:], strict=False))
        return uni, bi, sum(uni.values())

    def lower_words(t):
        return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words(t)]

    def loss(m, t):
        (uni, bi, n), result, ws = m, 0.0, lower_words(t)
        for k, w in enumerate(ws):
            share = sum(x[0][w] for x in models) / sum(x[2] for x in models)
            p = (uni[w] + lm_scores.MU * share) / (n + lm_scores.MU)
            if k:
                p = (bi[ws[k - 1], w] + lm_scores.MU * p) / (uni[ws[k - 1]] + lm_scores.MU)
            result -= np.log(p)
        return result / max(len(ws), 1)

    models = model([t for (t,) in target]), model([t for _, t, _ in rows])
    want = sorted((i if i is not None else -1, len(words(t)), *(round(loss(m, t), 6) for m in models)) for i, t, _ in rows if len(t or "") < 5000)
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, round(r.target_loss, 6), round(r.background_loss, 6)) for r in got if r.n_tokens < 5000)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(want, have, strict=True))
    assert all(abs(r.score - (r.target_loss - r.background_loss)) < 1e-9 for r in got)
    assert lm_scores.lm_scores(empty(spark), spark.createDataFrame(target, "text string")).count() == 0
    none = lm_scores.lm_scores(frame(spark, rows), spark.createDataFrame([], "text string")).collect()
    assert len(none) == len(rows) and all(np.isfinite(r.score) for r in none)


def test_repeated_rows_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(lm_scores, "n_buckets", lambda *_: 16)
    docs = frame(spark, [(1, "the same words again and again", "s")] * 4000)
    place = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(16))
    most = docs.groupBy(place).count().agg(F.max("count")).first()[0]
    assert most < 400
    got = lm_scores.lm_scores(docs, spark.createDataFrame([("the same words",)], "text string")).collect()
    assert len(got) == 4000 and len({(x.target_loss, x.background_loss) for x in got}) == 1


# --- queries and pipeline --------------------------------------------------

@pytest.mark.parametrize("name", ["op1_substring_dedup", "op6_vector_search", "op7_jaccard_join", "op12_embedding_dedup"])
def test_query_matches_its_sql(spark, name):
    import __spark_entry__ as E

    r = compare(spark, duck_con(SF), name, E.queries()[name], E.oracle_sql()[name], SF)
    assert r["status"] == "ok", r


def test_pipeline_stages(spark, scratch):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "jaccard_join", "substring_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{scratch}/{name}")
        before, docs = docs, spark.read.parquet(f"{scratch}/{name}")
        seen[name] = before.collect(), docs.collect()
        assert name == "packing" or docs.columns == columns
    rows, kept = seen["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    score = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect()}
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in rows if not score[r.doc_id])
    rows, kept = seen["jaccard_join"]
    groups = brute_components([(r.doc_id, r.text, None) for r in rows], 5, 80)
    assert sorted(r.doc_id for r in kept) == sorted({c for _, _, c in groups})
    rows, kept = seen["substring_dedup"]
    least = {}
    for r in rows:
        w = words(r.text)
        for k in range(len(w) - 12):
            least[tuple(w[k:k + 13])] = min(least.get(tuple(w[k:k + 13]), r.doc_id), r.doc_id)
    want = {}
    for r in rows:
        w, gone = words(r.text), set()
        for k in range(len(w) - 12):
            if least[tuple(w[k:k + 13])] < r.doc_id:
                gone |= set(range(k, k + 13))
        text = b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else r.text
        if len(gone) < len(w) or not gone:
            want[r.doc_id] = (text, len(text))
    assert {r.doc_id: (r.text, r.n_chars) for r in kept} == want
    rows, kept = seen["mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(spark.createDataFrame(rows)).collect()}
    assert collections.Counter(r.doc_id for r in kept) == +collections.Counter(copies)
    assert {r.doc_id: r.text for r in kept}.items() <= {r.doc_id: r.text for r in rows}.items()
    rows, pieces = seen["packing"]
    assert sorted({r.doc_id for r in pieces}) == sorted({r.doc_id for r in rows})
    total = collections.Counter()
    for p in pieces:
        total[p.doc_id] += p.length
    tokens = {p.doc_id: p.doc_tokens for p in pieces}
    assert total == {d: tokens[d] * n for d, n in collections.Counter(r.doc_id for r in rows).items()}
    assert docs.count() == corpus_pipeline.run(spark, SF).count()


def test_pipeline_keeps_a_text_of_each_group_whatever_the_ids(spark):
    base = {g: " ".join(f"{g}{k}" for k in range(120)) for g in "abcdefgh"}
    near = lambda g, k: base[g].replace(f"{g}50", f"y{k}")
    rows = [(None, base[g], "s") for g in "abc"] + [(None, near("c", 1), "s"), (None, base["a"], "s"), (None, None, "s"), (None, "", "s")]
    rows += [(1, base["d"], "s"), (1, base["e"], "s"), (1, near("e", 1), "s"), (2, base["f"], "s"), (None, near("f", 1), "s"), (3, near("f", 2), "s"),
             (4, base["g"], "s"), (4, base["g"], "s"), (5, base["h"], "s")]
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.jaccard_join(spark, frame(spark, rows), SF).collect())
    sure = [(None, base["a"]), (None, base["b"]), (1, base["d"]), (2, base["f"]), (4, base["g"]), (5, base["h"]), (None, None), (None, "")]
    assert all(got[x] == 1 for x in sure)
    assert sum(got[None, near("c", k)] for k in (0, 1)) + got[None, base["c"]] == 1
    assert got[1, base["e"]] + got[1, near("e", 1)] == 1
    assert got.total() == len(sure) + 2


def test_pipeline_stages_keep_clashing_columns_and_rows_without_words(spark):
    extra = ("n_words", "n_removed", "removed", "kept_text", "kept", "copies", "row", "id", "key", "text_hash", "class_id", "root", "size", "bits", "score", "a.b")
    texts = {i: " ".join(f"{i}x{k}" for k in range(30 + i)) for i in range(9)} | {20: "", 21: None, 22: " \n"}
    rows = [(i, t, "en", "s1" if i % 2 else "s0", 1) for i, t in texts.items()] + [(5, texts[5], "de", "s2", 1), (5, texts[5], "fr", "s2", 1)]
    docs = spark.createDataFrame([(*x, *[f"{c}{x[0]}" for c in extra]) for x in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all(x[c] == f"{c}{x.doc_id}" for x in got for c in extra), name
        if name == "toxicity":
            scores = toxicity.toxicity_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
            assert sorted(x.doc_id for x in got) == sorted(x.doc_id for x in scores if not x.predicted)
        else:
            assert {x.doc_id for x in got} >= {20, 21, 22}, name
        if name == "jaccard_join":
            assert sorted(x.doc_id for x in got) == sorted(texts)
        if name == "mixing":
            whole = {(x.doc_id, x.source): 0 for x in docs.collect()}
            for x in mixing.mix_sources(docs).collect():
                whole[x.doc_id, x.source] += x.copies
            assert collections.Counter((x.doc_id, x.source) for x in got) == +collections.Counter(whole)
            assert all(whole[i, "s1" if i % 2 else "s0"] == 1 for i in (20, 21, 22))
    assert {x.doc_id for x in corpus_pipeline.packing(spark, docs, SF).collect()} == set(texts)


def test_pipeline_stages_take_awkward_and_empty_tables(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = frame(spark, awkward()).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], columns), SF).count() == 0
        out = stage(spark, docs, SF)
        assert out.count() > 0
