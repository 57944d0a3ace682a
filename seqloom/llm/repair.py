"""Repair of conversation structure by divide and conquer in linear space.

A repaired conversation has the role initials `(s?(ua)+)?`. Four states tell what may come next: nothing yet, after the system row, after a user row,
after an assistant row. Edits are Keep (0), Rerole to user or assistant (3), Delete (4) and Insert of an empty user or assistant row (3); an
undeleted truncated row costs 3 more; blank and duplicate rows must go. Of the cheapest edits the audit, their initials in order, is least in ASCII.

`solve` finds them as Hirschberg does: a forward vector of four costs over the first half and a backward one over the second meet at
the middle, right after a row is used up. Next to each forward cost stands the rank of the least audit that reaches its state. Given a state and a letter the next
state is fixed, and no audit up to a row is the beginning of another one up to the same row, so among the cheapest crossings the one of the lowest rank is
on the least audit. Both halves are solved in the same way between known states; nothing but the vectors is kept.

Rows are put in order by range partitions of (conversation, turn, role, digest of the text), so a conversation of any length spreads over many tasks. A conversation
that lies inside a partition and has at most `CHUNK_ROWS` rows is finished there. All others leave chunks: each one's summary holds cost and
rank from every state to every state, the same crossing search over summaries gives each chunk its two states, and the chunks are solved in tasks of their own.
The SHA-256 of a conversation is a chain, so its pieces stream in order through one task that holds one piece at a time.

Defined results: null ids, turns, roles and texts read as one space in the damage key and in texts; a null turn comes first and counts for no gap;
rows of one turn follow role, then the digest of the text; rows that are alike in all of these count as copies, all but the first
being duplicates; a null conversation id is a conversation; a role's initial is its first character, an empty role has none and is in no legal pair;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import HEAVY_PART
from seqloom.session import settle

#: Rows and characters after which an open conversation starts a new chunk.
CHUNK_ROWS, CHUNK_CHARS = 4_096, 1 << 20
# The costs of edits, and white space.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a user or assistant row leads to, and what the row is called; nothing but these may be inserted.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_NAME = {USER: "user", ASSISTANT: "assistant"}
#: Cost and audit of ending in a state.
_END = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}

Step = dict[tuple[int, int], tuple[int, object]]  # (from, to) -> (cost, what tells two ways from one state apart)


def _row_steps(code: str) -> Step:
    """Cheapest edits of one row, inserts before it included; a code is the role's initial, upper case when truncated."""
    initial, extra = code.lower(), TRUNCATED * code.isupper()
    out: Step = {}

    def offer(a: int, b: int, cost: int, audit: str) -> None:
        if (a, b) not in out or (cost, audit) < out[a, b]:
            out[a, b] = (cost, audit)

    for a in range(4):
        at, cost, audit = a, 0, ""
        for _ in range(4):
            offer(a, at, cost + DELETE, audit + "D")
            offer(a, _NEXT[at], cost + REROLE + extra, audit + "R")
            kept = SYSTEM if initial == "s" and at == START else _NEXT[at] if initial == {USER: "u", ASSISTANT: "a"}[_NEXT[at]] else None
            if kept is not None:
                offer(a, kept, cost + extra, audit + "K")
            at, cost, audit = _NEXT[at], cost + INSERT, audit + "I"
    return out


ROW = {c: _row_steps(c) for c in "suaoSUAO"}

Vector = dict[int, tuple[int, int]]  # state -> (cost, rank)


def forward(steps: Sequence[Step], vector: Vector) -> Vector:
    """Cheapest way to every state, and the rank of its least audit among the states."""
    for step in steps:
        best: dict[int, tuple] = {}
        for (a, b), (cost, tie) in step.items():
            if a in vector:
                have = vector[a]
                way = (have[0] + cost, have[1], tie)
                if b not in best or way < best[b]:
                    best[b] = way
        order = sorted(best, key=lambda b: best[b][1:])
        vector = {b: (best[b][0], rank) for rank, b in enumerate(order)}
    return vector


def backward(steps: Sequence[Step], ends: dict[int, int]) -> dict[int, int]:
    """Cheapest way from every state to an end."""
    for step in reversed(steps):
        costs: dict[int, int] = {}
        for (a, b), (cost, _) in step.items():
            if b in ends and (a not in costs or cost + ends[b] < costs[a]):
                costs[a] = cost + ends[b]
        ends = costs
    return ends


def crossing(left: Vector, right: dict[int, int]) -> int:
    """State of the cheapest crossing, of the least audit among equals."""
    return min((left[q][0] + right[q], left[q][1], q) for q in left if q in right)[2]


def solve(steps: Sequence[Step], start: int, end: int) -> list[tuple[int, int]]:
    """States before and after every step on the least of the cheapest ways from `start` to `end`."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(steps), start, end)]
    while todo:
        lo, hi, a, b = todo.pop()
        if hi - lo <= 1:
            out += [(a, b)] * (hi - lo)
            continue
        mid = (lo + hi) // 2
        q = crossing(forward(steps[lo:mid], {a: (0, 0)}), backward(steps[mid:hi], {b: 0}))
        todo += [(mid, hi, q, b), (lo, mid, a, q)]
    return out


def finish(vector: Vector) -> tuple[int, int, str]:
    """Last state, total cost and closing inserts."""
    end = crossing(vector, {q: c for q, (c, _) in _END.items()})
    return end, vector[end][0] + _END[end][0], _END[end][1]


@lru_cache(maxsize=20_000)
def _short(codes: str) -> tuple[int, tuple[str, ...], str]:
    return _repair(codes)


def _repair(codes: str) -> tuple[int, tuple[str, ...], str]:
    steps = [ROW[c] for c in codes]
    end, cost, tail = finish(forward(steps, {START: (0, 0)}))
    return cost, tuple(ROW[c][way][1] for c, way in zip(codes, solve(steps, START, end))), tail


def repair(codes: str) -> tuple[int, tuple[str, ...], str]:
    """Cost, audit per row and closing inserts of a whole conversation of rows that may stay."""
    return _short(codes) if len(codes) <= 64 else _repair(codes)


def apply(audits: Sequence[str], tail: str, roles: Sequence[str], texts: Sequence[str], state: int = START) -> list[str]:
    """The repaired `role:text` lines."""
    lines = []
    for audit, role, text in zip(audits, roles, texts):
        for letter in audit:
            if letter == "D":
                continue
            kept_system = letter == "K" and role[:1] == "s"
            state = SYSTEM if kept_system else _NEXT[state]
            if letter == "I":
                lines.append(_NAME[state] + ":")
            else:
                lines.append(f"{role if letter == 'K' else _NAME[state]}:{text}")
    for _ in tail:
        state = _NEXT[state]
        lines.append(_NAME[state] + ":")
    return lines


def damage(conversations: DataFrame) -> DataFrame:
    """`(conv_id, turn, role, text, copies)` after the fixed damage; a dropped row stays with no copies, so that its conversation does."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("_k"))
    text = F.when(F.col("_k") <= 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == 0, "").when(F.col("_k") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_k") == 0, 0).when(F.col("_k") == 3, 2).otherwise(1).alias("copies"))


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, nulls in role and text as one space."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"), F.lit(1).alias("copies"))


def _identity() -> Column:
    return F.sha1(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))


def _place() -> Column:
    """A turn as something that orders, null first."""
    return F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))


def with_faults(rows: DataFrame) -> DataFrame:
    """One row per conversation, turn, role and text: `copies`, whether it is blank, said before, or truncated."""
    rows = rows.withColumn("key", _identity())
    # What is said in several turns of one conversation, with the first of them; this side carries no texts.
    said = rows.filter("copies > 0").select("key", _place().alias("p")).groupBy("key").agg(F.min("p").alias("first"), F.max("p").alias("last"), F.count("*").alias("n"))
    said = settle(said.filter("first < last").select("key", "first", "n"))
    total = rows.agg(F.count("*")).first()[0]
    heavy = said.filter(F.col("n") > total * HEAVY_PART).select(F.col("key").alias("hk"), F.col("first").alias("hf"))  # fewer than 1 / HEAVY_PART
    light = said.filter(F.col("n") <= total * HEAVY_PART).select(F.col("key").alias("lk"), F.col("first").alias("lf"))
    grouped = rows.groupBy("conv_id", "turn", "role", "text", "key").agg(F.sum("copies").alias("copies"))
    marked = grouped.join(F.broadcast(heavy), F.col("key") == F.col("hk"), "left")
    # A heavy key needs no second look; its rows go wherever their turn sends them.
    marked = marked.withColumn("lk_", F.when(F.col("hk").isNull(), F.col("key")).otherwise(F.concat(F.lit("-"), F.xxhash64("turn", "key").cast("string"))))
    marked = marked.join(light, F.col("lk_") == F.col("lk"), "left").withColumn("first", F.coalesce("hf", "lf"))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    return marked.select(
        "conv_id", "turn", "role", "text", "copies", (bare == "").alias("blank"), F.coalesce(_place() > F.col("first"), F.lit(False)).alias("again"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"))


_CHUNK = """conv_id long, part int, seq int, closed boolean, min_turn long, max_turn long, n_turns long, first_initial string, last_initial string, blank long, duplicate long,
truncated long, illegal long, forced long, cost long, audit string, repaired_sha256 string, codes string, gone array<long>, roles array<string>, texts array<string>, costs array<long>, ranks array<int>"""
_LEGAL = {"su", "ua", "au"}


class _Run:
    """Rows of one conversation, or of a chunk of one, that follow each other."""

    def __init__(self, conv):
        self.conv = conv
        self.turns, self.first_turn, self.last_turn = 0, None, None
        self.first, self.last, self.rows = None, None, 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.codes, self.gone, self.roles, self.texts, self.chars = [], [0], [], [], 0

    def add(self, turn, role, text, copies, blank, again, truncated) -> None:
        if not copies:
            return
        initial = role[:1]
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            if self.first_turn is None:
                self.first_turn = turn
        if self.last is None:
            self.first = initial
        elif self.last + initial not in _LEGAL:
            self.illegal += 1
        self.last = initial
        self.illegal += copies - 1  # no legal pair has equal initials
        self.rows += 1
        if blank or again:
            self.gone[-1] += copies
            if blank:
                self.blank += copies
            else:
                self.duplicate += copies
            return
        self.truncated += truncated
        code = initial if initial in ("s", "u", "a") else "o"
        self.codes.append(code.upper() if truncated else code)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)
        self.gone.append(copies - 1)
        self.duplicate += copies - 1

    def row(self, part: int, seq: int, closed: bool) -> tuple:
        forced, codes = sum(self.gone), "".join(self.codes)
        head = (self.conv, part, seq, closed, self.first_turn, self.last_turn, self.turns, self.first, self.last, self.blank, self.duplicate, self.truncated, self.illegal, forced)
        if closed:
            cost, audits, tail = repair(codes)
            lines = apply(audits, tail, self.roles, self.texts)
            return (*head, cost + DELETE * forced, _with_deletes(audits, self.gone) + tail, hashlib.sha256("\n".join(lines).encode()).hexdigest(), None, None, None, None, None, None)
        steps = [ROW[c] for c in codes]
        costs, ranks = [], []
        for a in range(4):
            vector = forward(steps, {a: (0, 0)})
            costs += [vector[b][0] if b in vector else -1 for b in range(4)]
            ranks += [vector[b][1] if b in vector else -1 for b in range(4)]
        return (*head, None, None, None, codes, self.gone, self.roles, self.texts, costs, ranks)


def _with_deletes(audits: Sequence[str], gone: Sequence[int]) -> str:
    return "D" * gone[0] + "".join(a + "D" * g for a, g in zip(audits, gone[1:]))


def _fields(schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _emit(rows: list[tuple], fields) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields)], schema=fields)


def chunks(rows: DataFrame, most_rows: int = CHUNK_ROWS) -> DataFrame:
    """Finished conversations, and the chunks of those that reach the edge of a partition or are long."""
    fields = _fields(_CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, current, edge, out, chars = TaskContext.get().partitionId(), 0, None, True, [], 0
        for b in batches:
            for conv, *row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                if current is None or conv != current.conv or current.rows >= most_rows or current.chars >= CHUNK_CHARS:
                    if current is not None:
                        more = conv == current.conv
                        out.append(current.row(part, seq, closed=not edge and not more))
                        chars += current.chars
                        # What follows the first run starts inside the partition, unless it goes on with the same conversation.
                        seq, edge = seq + 1, more
                    current = _Run(conv)
                current.add(*row)
            if len(out) >= 1_000 or chars >= CHUNK_CHARS:
                yield _emit(out, fields)
                out, chars = [], 0
        if current is not None:
            out.append(current.row(part, seq, closed=False))
        if out:
            yield _emit(out, fields)

    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    # Range bounds are sampled rows, so the digest stands for the text.
    keyed = rows.withColumn("_d", F.md5(F.col("text").cast("binary")))
    order = ["conv_id", "turn", "role", "_d"]
    kept = F.col("blank") | F.col("again") | (F.col("copies") == 0)
    placed = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return placed.select("conv_id", "turn", "role", F.when(~kept, F.col("text")).otherwise("").alias("text"), "copies", "blank", "again", "truncated").mapInArrow(run, _CHUNK)


_STATES = "part int, seq int, start int, stop int, tail string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _join_chunks(parts) -> Iterator[tuple]:
    """States and totals for the chunks of one conversation, in order."""
    steps: list[Step] = [{(a, b): (int(p["costs"][4 * a + b]), int(p["ranks"][4 * a + b])) for a in range(4) for b in range(4) if p["costs"][4 * a + b] >= 0} for p in parts]
    end, cost, tail = finish(forward(steps, {START: (0, 0)}))
    states = solve(steps, START, end)
    turns, last_turn, last, first_turn = 0, None, None, None
    total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "forced"), 0)
    for p in parts:
        for name in total:
            total[name] += int(p[name])
        if p["first_initial"] is not None:
            total["illegal"] += last is not None and last + p["first_initial"] not in _LEGAL
            last = p["last_initial"]
        if p["n_turns"]:
            turns += int(p["n_turns"]) - (p["min_turn"] == last_turn)
            first_turn = p["min_turn"] if first_turn is None else first_turn
            last_turn = p["max_turn"]
    gaps = int(last_turn) - int(first_turn) + 1 - turns if turns else 0
    for i, (p, (a, b)) in enumerate(zip(parts, states)):
        yield (p["part"], p["seq"], a, b, tail if i == len(parts) - 1 else "", gaps, total["blank"], total["duplicate"], total["truncated"], total["illegal"], cost + DELETE * total["forced"])


def states_of(opened: DataFrame) -> DataFrame:
    """States before and after every chunk; a conversation's chunk summaries, one for 4,096 rows, meet in one task and carry no texts."""
    fields = _fields(_STATES)
    columns = ["conv_id", "part", "seq", "min_turn", "max_turn", "n_turns", "first_initial", "last_initial", "blank", "duplicate", "truncated", "illegal", "forced", "costs", "ranks"]

    def run(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda p: (p["part"], p["seq"]))
        return pa.Table.from_batches([_emit(list(_join_chunks(parts)), fields)])

    return opened.select(*columns).groupBy("conv_id").applyInArrow(run, _STATES)


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PIECE = _RESULT.replace("repaired_sha256 string", "part int, seq int, n_lines long, piece string")


def pieces(opened: DataFrame, states: DataFrame) -> DataFrame:
    """Audit and repaired lines of every chunk."""
    fields = _fields(_PIECE)
    rows = opened.select("conv_id", "part", "seq", "codes", "gone", "roles", "texts").join(states, ["part", "seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 64):
                out = []
                for p in b.slice(start, 64).to_pylist():
                    ways = solve([ROW[c] for c in p["codes"]], p["start"], p["stop"])
                    audits = [ROW[c][way][1] for c, way in zip(p["codes"], ways)]
                    lines = apply(audits, p["tail"], p["roles"], p["texts"], p["start"])
                    out.append((p["conv_id"], p["gaps"], p["blank"], p["duplicate"], p["truncated"], p["illegal"], p["cost"],
                                _with_deletes(audits, p["gone"]) + p["tail"], p["part"], p["seq"], len(lines), "\n".join(lines)))
                yield _emit(out, fields)

    return rows.mapInArrow(run, _PIECE)


def digests(parts: DataFrame) -> DataFrame:
    """One row per conversation; pieces pass in order, none is kept."""
    fields = _fields(_RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sha, audit, lines = None, None, [], 0

        def close():
            return (*head, "".join(audit), sha.hexdigest())

        for b in batches:
            out = []
            for row in b.to_pylist():
                now = tuple(row[n] for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
                if head is None or head[0] != now[0]:
                    if head is not None:
                        out.append(close())
                    head, sha, audit, lines = now, hashlib.sha256(), [], 0
                audit.append(row["audit"])
                if row["n_lines"]:
                    sha.update(("\n" if lines else "").encode() + row["piece"].encode())
                    lines += row["n_lines"]
            if out:
                yield _emit(out, fields)
        if head is not None:
            yield _emit([close()], fields)

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(run, _RESULT)


def reconstruct(rows: DataFrame, most_rows: int = CHUNK_ROWS) -> DataFrame:
    """Faults, cheapest edits and the digest of the repair, for conversations as `damage` or `undamaged` gives them."""
    found = settle(chunks(with_faults(rows), most_rows))
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps")
    closed = found.filter("closed").select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    opened = found.filter("NOT closed")
    return closed.unionByName(digests(pieces(opened, states_of(opened))))
