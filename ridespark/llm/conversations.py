"""Repair of conversations whose roles do not alternate, by the lightest derivation of a legal one.

A legal conversation is empty, or an optional system message and one or more pairs of a user and an
assistant message. Only initials of roles count. Messages are kept, given another role, deleted or
inserted (`WEIGHTS`); a blank message, and one whose role and text came before, must be deleted; one
that does not end in a sign `[.!?]` costs more while it stays. The repair is the one of least cost
whose edits, written as initials in order, come first in ASCII order.

Items say that some leading messages have been repaired so as to end in a state. An edit deduces an
item from another and a weight: the function (cost + weight, audit + initial) is monotone and never
falls, so Knuth's agenda pops every item once, with its lightest derivation, until the goal is
popped. Messages of one conversation are sorted over partitions; a conversation may lie in many. The
first and the last of a partition, and one of over `SEGMENT` messages or bytes of text, may go on elsewhere: for
these, a task derives one item for every pair of a state before and a state after its messages.
Joining two such items is a deduction with two antecedents; they are joined in order, and the states
on the lightest path then select each segment's edits. No task holds all messages of a conversation.

A null turn comes first, then turns ascend; messages of one turn come by role and then by the MD5 of
their text, nulls as one space. Equal messages of one turn count as repeats. A null conversation id
is a conversation. A conversation without messages is legal. An empty table gives an empty one.
Other columns are not read. Only the digest of a conversation in several segments is a chain over
all its texts, which one task streams through.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .tables import written

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
#: Messages, and bytes of text, of one conversation that a task holds at a time, and messages of one agenda.
SEGMENT, SEGMENT_BYTES, AGENDA = 50_000, 16 << 20, 256

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a message of a role's initial, by the state before it.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The state that a message with a chosen role leads to, and that role.
CHOSEN = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
GOALS = (START, ASSISTANT)

#: An item's weight: cost and audit.
Weight = tuple[int, str]
#: Lightest weights by state before and state after some messages.
Spans = dict[tuple[int, int], Weight]


class Message(NamedTuple):
    """What the repair needs of a message: its role's initial and the weight of leaving it in. A weight of
    None stands for `times` messages in a row that must go: an insertion comes after all of them, as D is before I.
    """

    initial: str
    staying: int | None
    times: int = 1


def edits(state: int, message: Message) -> Iterator[tuple[int, int, str]]:
    """Weight, state after, and initials of each edit that uses up a message."""
    yield DELETE * message.times, state, "D" * message.times
    if message.staying is not None:
        if (after := AFTER.get((state, message.initial))) is not None:
            yield KEEP + message.staying, after, "K"
        yield REROLE + message.staying, CHOSEN[state][0], "R"


def agenda(messages: list[Message], start: int, goals: tuple[int, ...]) -> dict[int, Weight]:
    """The lightest derivation of each state of `goals` after all messages, from `start` before them.

    One goal of several is enough where they are START and ASSISTANT, the ends of a conversation:
    then the lightest of both is given alone.
    """
    n, done, found = len(messages), set(), {}
    either = goals == GOALS
    queue: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and state in goals:
            found[state] = cost, audit
            if either or len(found) == len(goals):
                break
        if i < n:
            for weight, after, initial in edits(state, messages[i]):
                if (i + 1, after) not in done:
                    heapq.heappush(queue, (cost + weight, audit + initial, i + 1, after))
        if (i, CHOSEN[state][0]) not in done:
            heapq.heappush(queue, (cost + INSERT, audit + "I", i, CHOSEN[state][0]))
    return found


def reachable(start: int) -> tuple[int, ...]:
    """States after some messages: the first two cannot be entered again."""
    return (START, SYSTEM, USER, ASSISTANT) if start == START else (SYSTEM, USER, ASSISTANT) if start == SYSTEM else (USER, ASSISTANT)


def spans(messages: list[Message]) -> Spans:
    """Items over some messages, for every state before and after them."""
    out = {}
    for start in range(4):
        # the states that only a kept or a deleted message can leave standing may have no derivation
        out |= {(start, end): w for end, w in agenda(messages, start, reachable(start)).items()}
    return out


def joined(left: Spans, right: Spans) -> Spans:
    """Items over the messages of both sides."""
    out: Spans = {}
    for (p, q), (cost, audit) in left.items():
        for (q2, r), (more, tail) in right.items():
            if q2 == q and ((p, r) not in out or cost + more <= out[p, r][0]):
                weight = cost + more, audit + tail
                out[p, r] = min(out.get((p, r), weight), weight)
    return out


def spans_of_segment(messages: list[Message]) -> Spans:
    """As `spans`, by agendas of bounded size that are joined two by two."""
    parts = [spans(messages[i : i + AGENDA]) for i in range(0, len(messages), AGENDA)] or [{(s, s): (0, "") for s in range(4)}]
    while len(parts) > 1:
        parts = [joined(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def derivation(messages: list[Message]) -> Weight:
    """The lightest repair of a whole conversation."""
    if len(messages) <= AGENDA:
        return min(agenda(messages, START, GOALS).values())
    whole = spans_of_segment(messages)
    return min(whole[START, s] for s in GOALS if (START, s) in whole)


def applied(state: int, audit: str, roles: list[str], texts: list[str], gone: list[int]) -> tuple[list[str], list[str]]:
    """Roles and texts that an audit leaves of some messages, from the state before them.

    `gone[i]` messages that must go stand before message i; the last number counts those after all.
    """
    out_roles, out_texts, i, must = [], [], 0, gone[0]
    for edit in audit:
        if edit == "D" and must:
            must -= 1
            continue
        if edit == "D":
            i, must = i + 1, gone[i + 1]
            continue
        if edit == "K":
            role, state = roles[i], AFTER[state, roles[i][:1]]
        else:
            state, role = CHOSEN[state]
        out_roles.append(role)
        out_texts.append("" if edit == "I" else texts[i])
        if edit != "I":
            i, must = i + 1, gone[i + 1]
    return out_roles, out_texts


# -- rows ---------------------------------------------------------------------------


def _space(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `n`, how often the row stands there, after the damage of its (conv_id, turn)."""
    fate = F.pmod(F.crc32(F.concat(_space("conv_id"), F.lit(":"), _space("turn"))), F.lit(20))
    text = F.when(fate == 1, "").when(fate == 2, F.translate(_space("text"), ".!?", "")).otherwise(_space("text"))
    role = F.when(fate == 4, "user").otherwise(_space("role"))
    n = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("long")
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), n.alias("n"))


#: What stands before a message in the order of a partition: the conversation itself, and the mark of a first occurrence.
CONVERSATION, FIRST, MESSAGE = 0, 1, 2


def _entries(rows: DataFrame) -> DataFrame:
    """One row per conversation, per distinct message, and per first occurrence of a role and text."""
    n = F.col("n")
    one = F.when(n > 0, F.col("text"))
    whole = rows.select("conv_id", F.when(n > 0, F.col("turn")).alias("turn"), F.when(n > 0, F.col("role")).alias("role"), one.alias("text"), "n")
    # rows that were dropped leave the conversation alone: one row without a role
    messages = written(whole.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("h", F.unhex(F.md5("text"))), "messages")
    place = F.struct(F.col("turn").isNotNull().alias("there"), "turn")
    first = messages.where("n > 0").groupBy("conv_id", "role", "h").agg(F.min(place)["turn"].alias("turn"))
    return messages.select("conv_id", "turn", "role", "h", F.when(n > 0, MESSAGE).otherwise(CONVERSATION).alias("kind"), "n", "text").unionByName(
        first.select("conv_id", "turn", "role", "h", F.lit(FIRST).alias("kind"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("text"))
    )


@dataclass
class Segment:
    """Consecutive messages of one conversation in one task."""

    conv: object
    turns: list = field(default_factory=lambda: [None, None, 0])  # least, greatest, how many
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    head: str | None = None
    tail: str | None = None
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    gone: list[int] = field(default_factory=lambda: [0])
    messages: list[Message] = field(default_factory=list)
    size: int = 0

    def add(self, turn: int | None, role: str, text: str, n: int, first: bool, blank: bool, finished: bool) -> None:
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        initial = role[:1]
        if self.head is None:
            self.head = initial
        else:
            self.illegal += not legal(self.tail, initial)
        self.illegal += n - 1
        self.tail = initial
        stays = first and not blank
        self.blank += n if blank else 0
        self.duplicate += 0 if blank else n - stays
        self.truncated += stays and not finished
        if stays:
            self.messages.append(Message(initial, 0 if finished else UNFINISHED))
            self.roles.append(role)
            self.texts.append(text)
            self.gone.append(0)
            self.size += len(text)
        if n > stays:
            self.messages.append(Message(initial, None, n - stays))
            self.gone[-1] += n - stays

    @property
    def full(self) -> bool:
        return len(self.messages) >= SEGMENT or self.size >= SEGMENT_BYTES


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au") and len(a) == 1


#: `spans` is null for a whole conversation, which has cost and audit instead; head and tail are initials.
SEGMENTS = (
    "conv_id {id}, part int, seq long, least long, greatest long, turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string, "
    "cost long, audit string, spans array<struct<p:int,q:int,cost:long,audit:string>>, roles array<string>, texts array<string>, gone array<long>"
)


def _segments(entries: DataFrame) -> DataFrame:
    """Segments of all conversations, whole ones repaired, by one sort over partitions."""
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "h", "kind")]
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    finished = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    laid = entries.repartitionByRange(parts, *order[:4]).sortWithinPartitions(*order)
    laid = laid.select("conv_id", "turn", "role", "kind", "n", F.when(F.col("kind") == MESSAGE, F.coalesce("text", F.lit(""))).alias("text"), blank.alias("blank"), finished.alias("finished"), F.spark_partition_id().alias("part"))
    spec = SEGMENTS.format(id=entries.schema["conv_id"].dataType.simpleString())
    schema = _arrow(spec)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, part, seq, marked, held = [], None, 0, 0, False, 0

        def close(s: Segment, whole: bool) -> None:
            nonlocal seq, held
            row = {"conv_id": s.conv, "part": part, "seq": seq, "least": s.turns[0], "greatest": s.turns[1], "turns": s.turns[2], "head": s.head, "tail": s.tail}
            row |= {k: int(getattr(s, k)) for k in ("blank", "duplicate", "truncated", "illegal")}
            if whole:
                row["cost"], row["audit"] = derivation(s.messages)
                row["roles"], row["texts"] = applied(START, row["audit"], s.roles, s.texts, s.gone)
            else:
                row["spans"] = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in spans_of_segment(s.messages).items()]
                row["roles"], row["texts"], row["gone"] = s.roles, s.texts, s.gone
            out.append(row)
            seq += 1
            held += s.size

        # what stands at the edge of a task, and what was cut, may have other segments
        edge = True
        for batch in batches:
            for conv, turn, role, kind, n, text, blank, finished, part in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if now is None:
                    now = Segment(conv)
                elif conv != now.conv:
                    close(now, not edge)
                    now, edge, marked = Segment(conv), False, False
                elif now.full:
                    close(now, False)
                    now, edge = Segment(conv), True
                if kind == FIRST:
                    marked = True
                elif kind == MESSAGE:
                    now.add(turn, role, text, n, marked, blank, finished)
                    marked = False
            if out and (len(out) >= 1000 or held >= SEGMENT_BYTES):
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
        if now is not None:
            close(now, False)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return laid.mapInArrow(run, spec)


def _arrow(spec: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(spec))


# -- conversations in several segments ------------------------------------------------


def _path(parts: list[Spans]) -> tuple[Weight, list[tuple[int, str]]]:
    """The lightest repair over consecutive segments: its weight, and the state before and edits of each segment."""
    level: list[list[Spans]] = [parts]
    while len(level[-1]) > 1:
        row = level[-1]
        level.append([joined(*row[i : i + 2]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)])
    whole = level[-1][0]
    weight, end = min((whole[START, s], s) for s in GOALS if (START, s) in whole)
    # down again: the state between two halves is the one whose weights add up to the whole's
    ways = [(START, end)]
    for row in reversed(level[:-1]):
        below = []
        for k, (p, r) in enumerate(ways):
            if 2 * k + 1 == len(row):
                below.append((p, r))
                continue
            left, right = row[2 * k], row[2 * k + 1]
            q = min((left[p, q][0] + right[q, r][0], left[p, q][1] + right[q, r][1], q) for q in range(4) if (p, q) in left and (q, r) in right)[2]
            below += [(p, q), (q, r)]
        ways = below
    return weight, [(p, part[p, q][1]) for part, (p, q) in zip(parts, ways, strict=True)]


_SUMS = ("blank", "duplicate", "truncated", "illegal")


def _resolve(table: pa.Table) -> pa.Table:
    """One row per segment of one conversation: the conversation's columns, the state before the segment and its edits."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    (cost, audit), ways = _path([{(s["p"], s["q"]): (s["cost"], s["audit"]) for s in r["spans"]} for r in rows])
    total = {k: sum(r[k] for r in rows) for k in _SUMS}
    some = [r for r in rows if r["head"] is not None]
    total["illegal"] += sum(not legal(x["tail"], y["head"]) for x, y in itertools.pairwise(some))
    some = [r for r in some if r["least"] is not None]
    again = sum(x["greatest"] == y["least"] for x, y in itertools.pairwise(some))
    gaps = some[-1]["greatest"] - some[0]["least"] + 1 - sum(r["turns"] for r in some) + again if some else 0
    return pa.Table.from_pylist(
        [
            {"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "gaps": gaps, **total, "cost": cost, "audit": None if k else audit, "before": p, "edits": a}
            for k, (r, (p, a)) in enumerate(zip(rows, ways, strict=True))
        ],
        pa.schema([(n, table.schema.field(n).type) if n in table.column_names else (n, t) for n, t in _RESOLVED.items()]),
    )


_RESOLVED = {"conv_id": None, "part": None, "seq": None, "gaps": pa.int64(), **dict.fromkeys(_SUMS, pa.int64()), "cost": pa.int64(), "audit": pa.string(), "before": pa.int32(), "edits": pa.string()}

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


class Repaired(NamedTuple):
    """`whole`: COLUMNS, roles and texts of every conversation that lies in one segment. `cut`: COLUMNS of the
    others; `parts`: their conv_id, part, seq, roles and texts, in the order of part and seq."""

    whole: DataFrame
    cut: DataFrame
    parts: DataFrame


def repaired(rows: DataFrame) -> Repaired:
    """Repair `rows` (conv_id, turn, role, text, n: how often the row stands there; 0 names a conversation only)."""
    segments = written(_segments(_entries(rows)), "segments")
    gaps = F.coalesce(F.col("greatest") - F.col("least") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    whole, cut = segments.where("spans is null"), segments.where("spans is not null")
    kind = rows.schema["conv_id"].dataType.simpleString()
    spec = f"conv_id {kind}, part int, seq long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, before int, edits string"
    resolved = written(cut.drop("roles", "texts", "gone", "audit", "cost").groupBy("conv_id").applyInArrow(_resolve, spec), "resolved")
    spec = f"conv_id {kind}, part int, seq long, roles array<string>, texts array<string>"
    schema = _arrow(spec)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.slice(i, 1).to_pylist()[0]
                roles, texts = applied(x["before"], x["edits"], x["roles"], x["texts"], x["gone"])
                yield pa.RecordBatch.from_pylist([{k: x[k] for k in ("conv_id", "part", "seq")} | {"roles": roles, "texts": texts}], schema)

    ways = cut.select("conv_id", "part", "seq", "roles", "texts", "gone").join(resolved.select("part", "seq", "before", "edits"), ["part", "seq"])
    return Repaired(whole.select("conv_id", gaps, *COLUMNS[2:], "roles", "texts"), resolved.where("audit is not null").select(*COLUMNS), ways.mapInArrow(run, spec))


def _chains(parts: DataFrame, name: str) -> DataFrame:
    """conv_id and the SHA-256 of the lines of all its parts, streamed in order."""
    spec = f"conv_id {parts.schema['conv_id'].dataType.simpleString()}, {name} string"
    schema = _arrow(spec)
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "part", "seq")]
    laid = parts.select("conv_id", "part", "seq", F.when(F.size("roles") > 0, _lines()).alias("lines")).repartition(tasks, "conv_id").sortWithinPartitions(*order).select("conv_id", "lines")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, empty = None, None, True
        for batch in batches:
            for conv, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or conv != now:
                    if digest is not None:
                        yield pa.RecordBatch.from_pylist([{"conv_id": now, name: digest.hexdigest()}], schema)
                    now, digest, empty = conv, hashlib.sha256(), True
                if lines is not None:
                    digest.update(lines.encode() if empty else b"\n" + lines.encode())
                    empty = False
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": now, name: digest.hexdigest()}], schema)

    return laid.mapInArrow(run, spec)


def _lines() -> Column:
    return F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")


def repair_digests(rows: DataFrame) -> DataFrame:
    """COLUMNS and repaired_sha256 (of the repaired `role:text`, joined by line feeds) of every conversation of `rows`, after their damage."""
    found = repaired(damaged(rows))
    whole = found.whole.select(*COLUMNS, F.sha2(_lines(), 256).alias("repaired_sha256"))
    digests = _chains(found.parts, "repaired_sha256").withColumnRenamed("conv_id", "_id")
    cut = found.cut.join(digests, F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")
    return whole.unionByName(cut)
