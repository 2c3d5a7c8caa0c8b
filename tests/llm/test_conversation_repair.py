"""Conversation repair against a plain restatement that tries all edits row by row."""

import hashlib
import random
import zlib

import pytest

from roomtrace.llm import conversation_repair as repair
from roomtrace.llm import queries

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, c string, chunk long, n string"
ALLOWED = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def brute(rows):
    """(blank, duplicate, truncated, illegal, gaps, cost, audit, repaired lines) of rows in order."""
    seen, faults = set(), []
    for turn, role, text in rows:
        solid = text.strip(SPACE)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0

    def inserted(states):
        work = dict(states)
        for _ in range(3):
            for q, (c, audit, lines) in list(work.items()):
                to, new = NEXT[q], (c + 3, audit + "I", lines + [FULL[NEXT[q]] + ":"])
                if to not in work or new[:2] < work[to][:2]:
                    work[to] = new
        return work

    states = inserted({"": (0, "", [])})
    for (turn, role, text), fault in zip(rows, faults):
        after = {}
        for q, (c, audit, lines) in states.items():
            ways = [(q, (c + 4, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                if (q, role[:1]) in ALLOWED:
                    ways.append((role[:1], (c + extra, audit + "K", lines + [f"{role}:{text}"])))
                ways.append((NEXT[q], (c + 3 + extra, audit + "R", lines + [f"{FULL[NEXT[q]]}:{text}"])))
            for to, new in ways:
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        states = inserted(after)
    cost, audit, lines = min((states[q] for q in ("", "a") if q in states), key=lambda x: x[:2])
    return (*(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, gaps, cost, audit, lines)


def conversation(r, n, roles=("system", "user", "assistant", "user", "assistant", "tool", "")):
    texts = ["Yes.", "No!", "why", " \t", "", "well, and then", "Long one? ", "fine...\n", "日本。"]
    return [(t, r.choice(roles), r.choice(texts) + (f" {r.randrange(40)}." if r.random() < 0.6 else "")) for t in sorted(r.sample(range(3 * n + 1), n))]


@pytest.mark.parametrize("seed", range(8))
def test_search_from_both_ends_finds_the_least_audit(seed):
    r = random.Random(seed)
    for _ in range(150):
        rows = conversation(r, r.randrange(0, 9))
        want = brute(rows)
        described, seen = [], set()
        for turn, role, text in rows:
            solid = text.strip(SPACE)
            fault = 1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0
            seen.add((role, text))
            described.append({"initial": {"s": 1, "u": 2, "a": 3}.get(role[:1], 0), "fault": fault, "n": 1, "row": (role, text)})
        layers = repair.layers_of(described)
        assert repair.cheapest(layers, 0, repair.DONE) == want[5:7]
        lines = [f"{role or x['row'][0]}:{x['row'][1] if x else ''}" for _, x, role in repair.apply_audit(described, want[6], 0)]
        assert lines == want[7]
        # the same through chunks of three rows
        chunks = []
        for k in range(0, len(described), 3):
            part = repair.layers_of(described[k:k + 3])
            found = [(s, t, repair.cheapest(part, s, (t,))) for s in range(4) for t in range(4)]
            chunks.append((k, [{"start": s, "end": t, "cost": x[0], "audit": x[1]} for s, t, x in found if x]))
        way = repair.fold(chunks)
        assert (sum(w.own for w in way), "".join(w.audit for w in way)) == want[5:7]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("bits", [1, 9])
def test_repair_is_brute_force(spark, bits):
    r = random.Random(5)
    rows = [(c, *x) for c in range(60) for x in conversation(r, r.randrange(1, 12))]
    rows += [(None, *x) for x in conversation(r, 9)] + [(100, *x) for x in conversation(r, 300)]
    rows += [(101, 5, "user", "Hi.")] * 40 + [(101, 6, "assistant", "Hello.")] + [(101, 7, "user", "Hi.")] * 3
    rows += [(102, None, "user", "Q."), (102, 4, "assistant", "A.")] + [(103, None, None, None)] + [(104, 0, "user", "word " * 50_000)]
    got = repair.repair_conversations(frame(spark, rows), chunk_bits=bits)
    report = {x.conv_id: x for x in got.report.collect()}
    lines, shas = {}, {x.conv_id: x.sha256 for x in repair.digests(got.rows).collect()}
    for x in sorted(got.rows.collect(), key=lambda x: (x.chunk, x.place)):
        lines.setdefault(x.conv_id, []).append(f"{x.role}:{x.text}")
    assert set(report) == {x[0] for x in rows}
    for c, x in report.items():
        own = [(t, " " if role is None else role, " " if text is None else text) for k, t, role, text in rows if k == c]
        own.sort(key=lambda y: (y[0] is not None, y[0] or 0))
        want = brute(own)
        assert (x.blank, x.duplicate, x.truncated, x.illegal, x.gaps, x.cost, x.audit) == want[:7], c
        assert lines.get(c, []) == want[7]
        assert shas.get(c) == (hashlib.sha256("\n".join(want[7]).encode()).hexdigest() if want[7] else None)


def test_rows_of_one_turn_have_an_order_of_their_own(spark):
    rows = [(1, 0, role, text) for role in ("user", "assistant", "system") for text in ("a.", "b.", "c")]
    one, two = (repair.repair_conversations(frame(spark, x)).report.collect() for x in (rows, rows[::-1]))
    assert one == two and one[0].gaps == 0


def test_empty_conversations(spark, tmp_path):
    got = repair.repair_conversations(frame(spark, [(1, 0, "user", "x")]).limit(0))
    assert got.report.count() == 0 and got.rows.count() == 0
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op11_conversation_repair(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", None])
def test_query_is_brute_force(spark, tmp_path, sf):
    if sf is None:  # awkward rows: nulls in every column, repeated rows, a conversation that is dropped whole
        sf = str(tmp_path)
        gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
        rows = [(1, 0, None, None), (1, None, "user", "Why?"), (None, 1, "user", "x."), (None, None, "assistant", "y!"), (2, 0, "user", " "),
                (gone, 0, "user", "z."), (3, 0, "system", "s."), (3, 0, "system", "s."), (3, 9, "user", "u")]
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{sf}/conversations.parquet")
    source = [tuple(x) for x in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {x.conv_id: x for x in queries.op11_conversation_repair(spark, sf).collect()}
    by = {}
    for c, t, role, text in source:
        own = by.setdefault(c, [])
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 1:
            text = ""
        if h == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        if h == 4:
            role = "user"
        own += [(t, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    assert set(got) == set(by)
    for c, rows in by.items():
        want = brute(sorted(rows, key=lambda y: (y[0] is not None, y[0] or 0)))
        x = got[c]
        assert (x.blank, x.duplicate, x.truncated, x.illegal, x.gaps, x.cost, x.audit) == want[:7], c
        assert x.repaired_sha256 == hashlib.sha256("\n".join(want[7]).encode()).hexdigest()
