"""Repair of conversation structure by cheapest edits.

A conversation is to read ``(s?(ua)+)?`` by the initials of its roles: perhaps a system row, then users and
assistants in turn.  Its rows are taken by turn (nulls first; rows of one turn by hashes of role and text, so
equal rows stand together).  A row is *blank* (no character but ``[\\x20\\x09-\\x0D]``), else *duplicate* (role
and text seen earlier in the conversation), else *truncated* (its last other character is not ``.``, ``!`` or
``?``).  Edits are Keep (0), Rerole to user or assistant (3), Delete (4, required for blank and duplicate rows)
and Insert of an empty user or assistant row (3); a truncated row that is not deleted costs 3 more.  The
*audit* is the string of the edits' initials; of the cheapest edits the one with the least audit is taken.

1. Rows are described by Spark expressions and numbers (initial, fault, hashes of role and text); equal rows
   are counted before they meet, and the earliest turn of each role and text tells duplicates.
2. They are range-partitioned and sorted by conversation and turn, so that a conversation may span any number
   of partitions, and cut into chunks of at most ``CHUNK`` rows.
3. A chunk is a lattice of rows by the initial last written.  A bidirectional Dijkstra search meets from both
   ends of it, and goes on while the two heaps may still give a crossing of equal cost; of these crossings
   the one with the least concatenated audit is the answer.  A chunk that is a whole conversation is searched
   once.  One of a longer conversation is searched between every two states, and a fold over the chunks'
   answers picks the cheapest, least audit.
4. Audits are applied to the chunks' rows; only rows that stay meet their texts again.

Defined results: a null role or text counts as one space; a null ``conv_id`` is a conversation of its own;
null turns come first and count in no gap; rows equal in conversation, role and text are all but one
duplicates; an empty table gives empty results; further columns are ignored.  The audit of a conversation is
one string, so that much of it (a character a row) meets in one task; its texts never do.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomtrace.llm.common import group_arrow, map_arrow, shared_checkpoint, ship

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
CHUNK_BITS = 9  # a chunk has at most 2 ** 9 rows
SPACE = " \t\n\x0b\x0c\r"
ROLES = {2: "user", 3: "assistant"}
# a state is the initial last written: 0 none, 1 s, 2 u, 3 a; so are the initials of rows (0: any other)
FOLLOWS = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}
WANTS = (2, 2, 3, 2)  # what Rerole and Insert write in each state
DONE = (0, 3)  # states that may end a conversation
_ROWS = "array<struct<turn:long,h1:long,h2:long,initial:int,fault:int,n:long>>"
_WAYS = "array<struct<start:int,end:int,cost:long,audit:string>>"


class Repair(NamedTuple):
    """``report``: ``conv_id, blank, duplicate, truncated, illegal, gaps, cost, audit`` per conversation;
    ``rows``: ``conv_id, chunk, place, role, text``, the repaired rows in the order of chunk and place."""

    report: DataFrame
    rows: DataFrame


def layers_of(rows: list[dict]) -> tuple[int, ...]:
    """Lattice layers of described rows: ``2 * initial + truncated``, or minus the rows that must go."""
    out: list[int] = []
    for r in rows:
        gone = r["n"]
        if r["fault"] in (0, 3):
            out.append(2 * r["initial"] + (r["fault"] == 3))
            gone -= 1
        if gone:  # a run of forced deletions is one layer: an insertion inside it only enlarges the audit
            if out and out[-1] < 0:
                out[-1] -= gone
            else:
                out.append(-gone)
    return tuple(out)


def _ahead(layers, i: int, q: int) -> Iterator[tuple[int, int, int, str]]:
    """Edges from state ``q`` before layer ``i``: layer, state, cost and audit."""
    yield i, WANTS[q], INSERT, "I"
    if i < len(layers):
        x = layers[i]
        if x < 0:
            yield i + 1, q, -DELETE * x, "D" * -x
            return
        extra = TRUNCATED * (x & 1)
        yield i + 1, q, DELETE, "D"
        if (q, x >> 1) in FOLLOWS:
            yield i + 1, x >> 1, extra, "K"
        yield i + 1, WANTS[q], REROLE + extra, "R"


def _behind(layers, i: int, q: int) -> Iterator[tuple[int, int, int, str]]:
    """Edges into state ``q`` before layer ``i``."""
    wanted = [p for p in range(4) if WANTS[p] == q]
    for p in wanted:
        yield i, p, INSERT, "I"
    if i > 0:
        x = layers[i - 1]
        if x < 0:
            yield i - 1, q, -DELETE * x, "D" * -x
            return
        extra = TRUNCATED * (x & 1)
        yield i - 1, q, DELETE, "D"
        if x >> 1 == q:
            for p in range(4):
                if (p, q) in FOLLOWS:
                    yield i - 1, p, extra, "K"
        for p in wanted:
            yield i - 1, p, REROLE + extra, "R"


@lru_cache(maxsize=1 << 14)
def cheapest(layers: tuple[int, ...], start: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
    """Least cost and least audit of the ways from ``start`` before the layers to one of ``goals`` behind them.

    Heaps are ordered by cost, then along the lattice (zero-cost edges lead to the next layer only), then by
    audit, so what is settled has the least audit of its cost.
    """
    end = len(layers)
    best: tuple[int, str] | None = None
    settled: tuple[dict, dict] = ({}, {})
    heaps: tuple[list, list] = ([], [])
    moves = (_ahead, _behind)

    def settle(side: int, cost: int, audit: str, i: int, q: int) -> None:
        nonlocal best
        own, other = settled[side], settled[1 - side]
        own[i, q] = cost, audit
        for j, p, w, label in moves[side](layers, i, q):
            text = audit + label if side == 0 else label + audit
            if (j, p) in other:
                c, rest = other[j, p]
                found = cost + w + c, (text + rest if side == 0 else rest + text)
                best = found if best is None or found < best else best
            if (j, p) not in own:
                heapq.heappush(heaps[side], (cost + w, -j if side else j, text, p))

    for g in goals:
        settled[1][end, g] = 0, ""
    for g in goals:
        settle(1, 0, "", end, g)
    settle(0, 0, "", 0, start)
    if not layers and start in goals:
        return 0, ""
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best[0]):
        side = int(heaps[0][0][0] > heaps[1][0][0])
        cost, j, audit, q = heapq.heappop(heaps[side])
        if (abs(j), q) not in settled[side]:
            settle(side, cost, audit, abs(j), q)
    return best


def apply_audit(rows: list[dict], audit: str, state: int) -> Iterator[tuple[int, dict | None, str | None]]:
    """Place in the audit, row (None: inserted) and new role (None: its own) of the rows that stay."""
    at, left = 0, rows[0]["n"] if rows else 0
    for place, edit in enumerate(audit):
        if edit != "I":
            while not left:
                at += 1
                left = rows[at]["n"]
            left -= 1
        if edit == "K":
            yield place, rows[at], None
            state = rows[at]["initial"]
        elif edit in "RI":
            state = WANTS[state]
            yield place, rows[at] if edit == "R" else None, ROLES[state]


class _Way(NamedTuple):
    """End of a chain of chunk answers."""

    cost: int
    before: "_Way | None"
    chunk: int
    start: int
    own: int
    audit: str

    def precedes(self, other: "_Way") -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        a, b, x, y = self, other, [], []
        while a is not b:  # audits differ only behind the last common chunk
            x.append(a.audit)
            y.append(b.audit)
            a, b = a.before, b.before
        return "".join(x[::-1]) < "".join(y[::-1])


def fold(chunks: list[tuple[int, list[dict]]]) -> list[_Way]:
    """Answers of a conversation's chunks on its cheapest way with the least audit."""
    best: dict[int, _Way | None] = {0: None}
    for chunk, ways in chunks:
        ahead: dict[int, _Way] = {}
        for w in ways:
            if w["start"] in best:
                b = best[w["start"]]
                new = _Way((b.cost if b else 0) + w["cost"], b, chunk, w["start"], w["cost"], w["audit"])
                if w["end"] not in ahead or new.precedes(ahead[w["end"]]):
                    ahead[w["end"]] = new
        best = ahead
    last = None
    for q in DONE:
        if q in best and (last is None or best[q].precedes(last)):
            last = best[q]
    out = []
    while last is not None:
        out.append(last)
        last = last.before
    return out[::-1]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list[dict]] = []
        for rows, alone in zip(b.column("rows").to_pylist(), b.column("alone").to_pylist()):
            layers = layers_of(rows)
            pairs = [(0, DONE)] if alone else [(s, (t,)) for s in range(4) for t in range(4)]
            found = [(s, g[0], cheapest(layers, s, g)) for s, g in pairs]
            out.append([{"start": s, "end": t, "cost": x[0], "audit": x[1]} for s, t, x in found if x is not None])
        ways = pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))
        yield pa.RecordBatch.from_arrays([b.column("c"), b.column("chunk"), b.column("rows"), b.column("alone"), ways],
                                         names=["c", "chunk", "rows", "alone", "ways"])


def _folded(table: pa.Table) -> pa.Table:
    chunks = sorted(zip(table.column("chunk").to_pylist(), table.column("ways").to_pylist()))
    way = fold(chunks)
    return pa.table({"c": pa.array(table.column("c").to_pylist()[:1] * len(way), pa.string()), "chunk": pa.array([w.chunk for w in way], pa.int64()),
                     "start": pa.array([w.start for w in way], pa.int32()), "cost": pa.array([w.own for w in way], pa.int64()),
                     "audit": pa.array([w.audit for w in way], pa.string())})


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for c, chunk, rows, start, audit in zip(*(b.column(x).to_pylist() for x in ("c", "chunk", "rows", "start", "audit"))):
            out += [(c, chunk, place, r and r["h1"], r and r["h2"], role) for place, r, role in apply_audit(rows, audit, start)]
        cols = list(zip(*out)) or [[]] * 6
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], names=["c", "chunk", "place", "h1", "h2", "role"])


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", chunk_bits: int = CHUNK_BITS) -> Repair:
    """Report and repaired rows of all conversations."""
    ship(rows.sparkSession)
    kind = rows.schema[conv_col].dataType
    base = rows.select(F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("c"),
                       F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
                       F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    base = base.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "text", "role")})
    back = F.when(F.col("c") != "", F.substring("c", 2, 1 << 30).cast(kind)).alias(conv_col)

    solid = F.rtrim("text", F.lit(SPACE))
    fault = F.when(solid == "", 1).when(F.substring(solid, -1, 1).isin(".", "!", "?"), 0).otherwise(3)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)
    small = base.groupBy("c", "turn", "h1", "h2").agg(F.max(initial).alias("initial"), F.max(fault).alias("fault"), F.count("*").alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = small.groupBy("c", "h1", "h2").agg(F.min(place).alias("earliest"))
    small = small.join(seen, ["c", "h1", "h2"])
    small = small.withColumn("fault", F.when((F.col("fault") != 1) & (place > F.col("earliest")), 2).otherwise(F.col("fault")))

    order = ["c", "turn", "h1", "h2"]  # unique
    ranged = small.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    row = ["turn", "h1", "h2", "initial", "fault", "n"]
    chunks = ranged.groupBy("c", F.shiftright("at", chunk_bits).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("at", *row))).alias("rows"))
    chunks = shared_checkpoint(chunks.withColumn("rows", F.transform("rows", lambda r: F.struct(*[r[x].alias(x) for x in row]))))
    parts = chunks.groupBy("c").agg(F.count("*").alias("parts"))
    solved = shared_checkpoint(map_arrow(
        chunks.join(parts, "c").select("c", "chunk", "rows", (F.col("parts") == 1).alias("alone")),
        _solve, f"c string, chunk long, rows {_ROWS}, alone boolean, ways {_WAYS}"))
    way = F.col("ways")[0]
    chosen = solved.where("alone").select("c", "chunk", "rows", way["start"].alias("start"), way["cost"].alias("cost"), way["audit"].alias("audit"))
    longer = solved.where("not alone")
    folded = group_arrow(longer.select("c", "chunk", "ways").groupBy("c"), _folded, "c string, chunk long, start int, cost long, audit string")
    chosen = chosen.unionByName(longer.select("c", "chunk", "rows").join(folded, ["c", "chunk"]))

    x = F.col("rows")
    illegal = F.aggregate(x, F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("n")), lambda s, r: F.struct(
        r["initial"].alias("last"), (s["n"] + r["n"] - 1 + F.when((s["last"] != -1) & ~_legal(s["last"], r["initial"]), 1).otherwise(0)).alias("n")))["n"]

    def total(amount):
        return F.aggregate(x, F.lit(0).cast("long"), lambda s, r: s + amount(r))

    counted = chosen.select(
        "c", "chunk", "cost", "audit", illegal.alias("illegal"),
        total(lambda r: F.when(r["fault"] == 1, r["n"]).otherwise(0)).alias("blank"),
        total(lambda r: F.when(r["fault"] == 2, r["n"]).when(r["fault"] == 1, 0).otherwise(r["n"] - 1)).alias("duplicate"),
        total(lambda r: F.when(r["fault"] == 3, 1).otherwise(0)).alias("truncated"),
        x[0]["initial"].alias("first"), F.element_at(x, -1)["initial"].alias("last"))
    report = counted.groupBy("c").agg(*[F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated", "illegal", "cost")],
                                      F.sort_array(F.collect_list(F.struct("chunk", "audit", "first", "last"))).alias("parts"))
    across = F.aggregate("parts", F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("n")), lambda s, p: F.struct(
        p["last"].alias("last"), (s["n"] + F.when((s["last"] != -1) & ~_legal(s["last"], p["first"]), 1).otherwise(0)).alias("n")))["n"]
    turns = chunks.select("c", F.explode("rows.turn").alias("turn")).groupBy("c").agg(
        F.max("turn").alias("most"), F.min("turn").alias("least"), F.countDistinct("turn").alias("distinct"))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("distinct"), F.lit(0).cast("long"))
    report = report.join(turns, "c").select(
        back, "blank", "duplicate", "truncated", (F.col("illegal") + across).alias("illegal"), gaps.alias("gaps"), "cost",
        F.array_join(F.transform("parts", lambda p: p["audit"]), "").alias("audit"))

    placed = map_arrow(chosen.select("c", "chunk", "rows", "start", "audit"), _applied, "c string, chunk long, place long, h1 long, h2 long, role string")
    texts = base.dropDuplicates(["c", "h1", "h2"]).select("c", "h1", "h2", F.col("role").alias("was"), "text")
    kept = placed.where("h1 is not null").join(texts, ["c", "h1", "h2"])  # a role and text of a conversation stay once at most
    new = placed.where("h1 is null").select(back, "chunk", "place", "role", F.lit("").alias("text"))
    return Repair(report, kept.select(back, "chunk", "place", F.coalesce("role", "was").alias("role"), "text").unionByName(new))


def _legal(a, b):
    return ((a == 1) & (b == 2)) | ((a == 2) & (b == 3)) | ((a == 3) & (b == 2))


def digests(rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``conv_id, sha256`` of each conversation's repaired ``role:text`` lines, joined by line feeds.

    Rows are sorted by conversation and streamed through a running hash, so that no conversation is held."""
    kind = rows.schema[conv_col].dataType
    lines = rows.select(F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("c"), "chunk", "place",
                        F.concat("role", F.lit(":"), "text").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        def ready(c, h):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()), pa.array(h, pa.string())], names=["c", "sha256"])

        at, state = None, None
        for b in batches:
            ids, found = [], []
            for c, line in zip(b.column("c").to_pylist(), b.column("line").cast(pa.large_binary())):
                if c != at:
                    if state is not None:
                        ids.append(at)
                        found.append(state.hexdigest())
                    at, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.as_buffer())
            yield ready(ids, found)
        if state is not None:
            yield ready([at], [state.hexdigest()])

    out = map_arrow(lines.repartition("c").sortWithinPartitions("c", "chunk", "place"), run, "c string, sha256 string")
    return out.select(F.when(F.col("c") != "", F.substring("c", 2, 1 << 30).cast(kind)).alias(conv_col), "sha256")
