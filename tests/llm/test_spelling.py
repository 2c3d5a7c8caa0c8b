"""Spelling variants against all pairs of words."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from roomtrace.llm import queries, spelling

SCHEMA = "doc_id long, text string, word string, n string, side int, block long"


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes a to b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k:] == b[k + 1:] or (len(a) == len(b) and a[k + 1:] == b[k + 1:])


def brute(counts, ratio=2):
    form, n_near = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        n_near[w] = len(others)
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, n_near[w], counts.get(form[w])))
    return out


def brute_counts(rows):
    out = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def variants(r, n, letters="abé", size=(5, 9)):
    words = {"".join(r.choice(letters) for _ in range(r.randint(*size))) for _ in range(n)}
    for w in list(words)[:n // 2]:
        k = r.randrange(len(w))
        words |= {w[:k] + w[k + 1:], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1:]}
    return sorted(w for w in words if len(w) >= 5)


@pytest.mark.parametrize("seed,letters,size", [(1, "ab", (5, 7)), (2, "abcé", (5, 9)), (3, "abcdefghijklmnopÿ", (5, 12)), (4, "a", (5, 40))])
def test_index_finds_all_words_with_one_error_behind_the_half(seed, letters, size):
    r = random.Random(seed)
    words = variants(r, 60, letters, size)
    codes = [spelling._codes(w, True) for w in words]
    half = np.array([len(w) // 2 for w in words])
    q, w = spelling.Index(codes).near(codes, half)
    got = {(words[i], words[j]) for i, j in zip(q, w) if i != j}
    assert got == {(a, b) for a in words for b in words if near(a, b) and b.startswith(a[:len(a) // 2]) and near(a[len(a) // 2:], b[len(a) // 2:])}


def test_index_of_nothing():
    nothing = spelling.Index([])
    assert [len(x) for x in nothing.near([spelling._codes("house", True)], np.array([2]))] == [0, 0]
    assert [len(x) for x in spelling.Index([spelling._codes("house", True)]).near([], np.zeros(0, np.int64))] == [0, 0]


@pytest.mark.parametrize("block,rows", [(1 << 16, 1 << 16), (7, 100), (3, 1 << 16)])
def test_groups_are_brute_force(spark, block, rows):
    r = random.Random(block)
    counts = {w: r.randrange(3, 200) for w in variants(r, 150, "abcé") + variants(r, 40, "xyz", (5, 6)) + ["inter" + x for x in variants(r, 60, "mno", (5, 6))]}
    counts |= {"q" * 300: 5, "q" * 301: 50, "q" * 302: 500, "zzzzz": 3}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert {tuple(x) for x in spelling.spelling_groups(frame, block=block, rows=rows).collect()} == brute(counts)


def awkward():
    r = random.Random(9)
    names = ["Straße", "straße", "STRASSE", "théâtre", "theatre", "thèâtre", "house", "houses", "hause", "horse", "mouse", "spelling", "speling", "spellling", "×÷×÷×", "naïve", "naive", "word1word"]
    rows = [(i, " ".join(r.choice(names) + r.choice(["", ",", "-", " 7", "日"]) for _ in range(40))) for i in range(60)]
    rows += [rows[0], (None, rows[1][1]), (None, None), (61, None), (62, ""), (63, "123 45"), (64, "houses " * 200_000), (65, "L" * 5000), (66, "L" * 5000), (67, "L" * 5000)]
    return rows


def test_counts_and_query_are_brute_force(spark, tmp_path):
    rows = awkward()
    frame = spark.createDataFrame([(*x, "w", "n", 1, 2) for x in rows], SCHEMA).repartition(4)
    want = brute_counts(rows)
    assert {x.word: x.n for x in spelling.count_words(frame, noise=True).collect()} == want
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_spelling_variants(spark, str(tmp_path)).collect()
    assert {tuple(x) for x in got} == brute(want) and len(got) == len(want)


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    counts = brute_counts(rows)
    got = {x.word: tuple(x) for x in queries.op13_spelling_variants(spark, sf).collect()}
    assert {w: x[3] for w, x in got.items()} == counts
    some = set(random.Random(1).sample(sorted(counts), min(300, len(counts))))
    for w in some:
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        fits = best is not None and counts[best] >= 2 * counts[w]
        assert (got[w][1], got[w][4], got[w][5]) == ((best, len(others), counts[best]) if fits else (None, len(others), None))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spelling.spelling_groups(spelling.count_words(empty)).count() == 0
