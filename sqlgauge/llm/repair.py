"""Repair of damaged conversations: cheapest edits by depth-first branch and bound.

Rows are told apart before anything is ordered: of the copies of a role and text in a conversation the first
(smallest turn) carries the text, all others are only counted, by turn. Both are range-sorted by conversation, turn,
role and digest, so a conversation that holds any share of the rows is spread over all tasks, and each task reads
its part as a stream, in segments of at most ``SEGMENT`` steps.

A conversation that lies inside one segment is searched and hashed there. The others leave, for each segment, the
best edits for every state before and after it (four by four). Neighbouring segments are joined ``FAN_IN`` at a
time by the same search, whose steps then are segments, until one is left. Equal costs are decided by the edits'
initials from left to right, which keeps its truth when pieces are put together: pieces of one cost between the
same states are never one the beginning of the other.

The digest of a repaired conversation reads its lines one after another: those of a conversation in many segments
are sorted and streamed through one task, which holds a batch of them at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sqlgauge.llm.common import materialize, table

#: Steps of a segment, and segments that one search joins. A search looks again at all that follows a node to
#: which it finds a better way, so short searches joined are much faster than a long one.
SEGMENT = 16
FAN_IN = 8

#: A mark that is no white space; a text that ends in one of the closing marks.
_INK = r"[^\x20\x09-\x0D]"
_CLOSED = r"[.!?][\x20\x09-\x0D]*\z"
_LEGAL = ("su", "ua", "au")

# States of a conversation read so far: nothing kept, or the role kept last.
_NONE, _SYSTEM, _USER, _ASSISTANT = "", "s", "u", "a"
STATES = (_NONE, _SYSTEM, _USER, _ASSISTANT)
_NEXT = {_NONE: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
#: Inserts that complete a conversation.
_ENDING = {_NONE: (0, ""), _SYSTEM: (10, "II"), _USER: (5, "I"), _ASSISTANT: (0, "")}

#: cost, initials of the edits, state after them
Move = tuple[int, str, str]
Step = dict[str, list[Move]]


# --- search ----------------------------------------------------------------------------------

def row_moves(initial: str, first: bool, truncated: bool, copies: int) -> Step:
    """Moves over the rows of one turn that are alike: the first of its kind (if ``first``) and ``copies`` others,
    which must go. A row is inserted only before one that stays: before a deleted one it costs the same, and ``D``
    comes before ``I``."""
    rest, tail = 2 * copies, "D" * copies
    if not first:
        return {state: [(rest, tail, state)] for state in STATES}
    stays = 5 if truncated else 0
    found: Step = {}
    for state in STATES:
        need = _NEXT[state]
        moves = [(2, "D", state)]
        for cost, letters, role in ((0, "", need), (5, "I", _NEXT[need])):
            moves.append((cost + stays, letters + "K", role) if initial == role
                         else (cost + stays + 1, letters + "R", role))
        if state == _NONE and initial == _SYSTEM:
            moves.append((stays, "K", _SYSTEM))
        found[state] = [(cost + rest, letters + tail, after) for cost, letters, after in moves]
    return found


def search(steps: list[Step], start: str, ending: dict[str, tuple[int, str]]) -> tuple[int, str] | None:
    """Least cost, and then least initials, from ``start`` over all steps to a state that has an ending.

    Depth first with an explicit stack. A node is a number of steps done and the state then; it is left when the
    best that can follow (every later step at its cheapest) is beyond the incumbent, or when its table of
    dominance knows a better way to it.
    """
    n = len(steps)
    bound = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        bound[i] = bound[i + 1] + min((m[0] for moves in steps[i].values() for m in moves), default=0)
    least_end = min((cost for cost, _ in ending.values()), default=0)
    best: tuple[int, str] | None = None
    seen: list[dict[str, tuple[int, str]]] = [{} for _ in range(n + 1)]
    stack: list[tuple[int, str, int, str]] = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if best is not None:
            least = cost + bound[i] + least_end
            if least > best[0] or least == best[0] and audit > best[1][:len(audit)]:
                continue
        known = seen[i].get(state)
        if known is not None and known <= (cost, audit):
            continue
        seen[i][state] = (cost, audit)
        if i == n:
            if state in ending:
                whole = (cost + ending[state][0], audit + ending[state][1])
                if best is None or whole < best:
                    best = whole
            continue
        # the cheapest move is looked at first, so it is pushed last
        for more, letters, after in sorted(steps[i].get(state, ()), reverse=True):
            stack.append((i + 1, after, cost + more, audit + letters))
    return best


def _between(steps: list[Step]) -> Step:
    """Best moves over all steps, for every state before and after them."""
    found: Step = {}
    for before in STATES:
        ways = ((after, search(steps, before, {after: (0, "")})) for after in STATES)
        found[before] = [(*way, after) for after, way in ways if way is not None]
    return found


# --- damage ----------------------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n``: a row and how often it is there after the damage (0: dropped)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = rows.select(
        F.col("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role").alias("role"),
        text("text").alias("text"),
        (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).cast("int").alias("_form"))
    form = F.col("_form")
    changed = F.when(form == 1, F.lit("")).when(form == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return named.select(
        "conv_id", "turn", F.when(form == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        changed.alias("text"), F.when(form == 0, 0).when(form == 3, 2).otherwise(1).alias("n"))


def told_apart(rows: DataFrame) -> DataFrame:
    """Rows by ``conv, turn, role, digest``: the first of each role and text of a conversation with its text, and
    the numbers ``n`` of rows of each turn (``text`` null)."""
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    blank, there = ~F.col("text").rlike(_INK), F.col("n") > 0
    # a row that is not there only says that there is this conversation
    counted = rows.select(
        "conv", F.when(there, F.col("turn")).alias("turn"), F.when(there, F.col("role")).otherwise("").alias("role"),
        F.when(there, digest).otherwise("").alias("digest"), (there & blank).alias("blank"), "n").groupBy(
        "conv", "turn", "role", "digest", "blank").agg(F.sum("n").cast("bigint").alias("n"))
    first = rows.where(there & ~blank).groupBy("conv", "role", "text").agg(
        F.bool_or(F.col("turn").isNull()).alias("_none"), F.min("turn").alias("_turn"))
    first = first.select("conv", F.when(~F.col("_none"), F.col("_turn")).alias("turn"), "role", digest.alias("digest"),
                         F.lit(False).alias("blank"), F.lit(0).cast("bigint").alias("n"), "text")
    return first.unionByName(counted.withColumn("text", F.lit(None).cast("string")))


# --- segments --------------------------------------------------------------------------------

_SUMS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")
_COUNTS = ", ".join(f"{c} bigint" for c in _SUMS) + ", first string, last string, low bigint, high bigint"
_MOVES = "moves array<struct<before: string, cost: bigint, letters: string, after: string>>"
_LINE = "initial: string, first: boolean, copies: bigint, role: string, text: string"
_SEGMENT = f"conv string, at bigint, {_COUNTS}, cost bigint, audit string, sha string, {_MOVES}, lines array<struct<{_LINE}>>"
_JOINED = f"conv string, at bigint, {_COUNTS}, {_MOVES}"
_ENDED = f"conv string, {_COUNTS}, cost bigint, audit string"


def _frame(records: list[dict], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split("array")[0].split(", ")] + ["lines"] * (schema == _SEGMENT)
    # as objects, so that whole numbers beside a null stay whole; turns may have come as text
    whole = lambda c, x: int(x) if x is not None and c in ("low", "high") else x
    return pd.DataFrame({c: pd.Series([whole(c, r.get(c)) for r in records], dtype=object) for c in names})


class _Counts:
    """Counts of neighbouring rows, or of neighbouring segments."""

    def __init__(self) -> None:
        self.sums = dict.fromkeys(_SUMS, 0)
        self.first = self.last = self.low = self.high = None

    def put(self, sums: dict[str, int], first: str, last: str, low: int | None, high: int | None) -> None:
        for c, n in sums.items():
            self.sums[c] += n
        self.sums["illegal"] += self.last is not None and self.last + first not in _LEGAL
        self.first, self.last = first if self.first is None else self.first, last
        if low is not None:
            self.sums["turns"] -= low == self.high
            self.low, self.high = low if self.low is None else self.low, high

    def record(self, conv: str, at: int) -> dict:
        return {"conv": conv, "at": at, "first": self.first, "last": self.last, "low": self.low, "high": self.high,
                **self.sums}


class _Part:
    """A segment while its rows are read; ``begins`` if no earlier task can hold rows of its conversation."""

    def __init__(self, conv: str, begins: bool):
        self.conv, self.begins, self.counts = conv, begins, _Counts()
        self.steps: list[Step] = []
        self.lines: list[dict] = []

    def add(self, turn: int | None, role: str, text: str | None, blank: bool, n: int, closed: bool) -> None:
        if not n:
            return
        initial, first = role[:1], text is not None
        self.counts.put({
            "rows": n, "blank": n if blank else 0, "duplicate": 0 if blank else n - first,
            "truncated": int(first and not closed), "turns": int(turn is not None),
            # rows that are alike stand side by side, and no pair of one role is legal
            "illegal": n - 1}, initial, initial, turn, turn)
        self.steps.append(row_moves(initial, first, not closed, n - first))
        self.lines.append({"initial": initial, "first": first, "copies": n - first, "role": role, "text": text})

    def record(self, at: int, whole: bool) -> dict:
        out = self.counts.record(self.conv, at)
        if not whole:
            return out | {"moves": _as_records(_between(self.steps)), "lines": self.lines}
        cost, audit = search(self.steps, _NONE, _ENDING)
        sha = _Digest(audit)
        for line in self.lines:
            sha.row(**line)
        return out | {"cost": cost, "audit": audit, "sha": sha.end()}


def _as_records(step: Step) -> list[dict]:
    return [{"before": before, "cost": cost, "letters": letters, "after": after}
            for before, moves in step.items() for cost, letters, after in moves]


def _as_step(records: list[dict]) -> Step:
    step: Step = {state: [] for state in STATES}
    for r in records:
        step[r["before"]].append((int(r["cost"]), r["letters"], r["after"]))
    return step


class _Digest:
    """SHA-256 of a repaired conversation, line by line, as its audit tells."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.lines, self.sha = audit, 0, _NONE, 0, hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.lines += 1

    def _insert(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.state, self.at = _NEXT[self.state], self.at + 1
            self._line(_ROLE[self.state], "")

    def row(self, initial: str, first: bool, copies: int, role: str, text: str | None) -> None:
        if first:
            self._insert()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "R":
                self.state = _NEXT[self.state]
                self._line(_ROLE[self.state], text)
            elif edit == "K":
                self.state = initial
                self._line(role, text)
        self.at += copies

    def end(self) -> str:
        self._insert()
        return self.sha.hexdigest()


def _segments(size: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Read a task's sorted rows and give the records of its segments.

    Conversations that begin and end in the task and are one segment are finished. The one at either end of the
    task may go on in another.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId() << 33
        part, key, row, done = None, None, None, []
        for frame in frames:
            for conv, turn, role, digest, blank, n, text, closed in frame.itertuples(index=False):
                if key != (conv, turn, role, digest):
                    if row is not None:
                        part.add(*row)
                    if part is None or part.conv != conv or len(part.steps) >= size:
                        other = part is not None and part.conv != conv
                        if part is not None:
                            done.append(part.record(at, part.begins and other))
                            at += 1
                        part = _Part(conv, other)
                    key, row = (conv, turn, role, digest), [None if turn is None else int(turn), role, None, False, 0, True]
                if text is None:
                    row[3:5] = bool(blank), int(n)
                else:
                    row[2], row[5] = text, bool(closed)
            if len(done) >= 1000:
                yield _frame(done, _SEGMENT)
                done = []
        if part is not None:
            part.add(*row)
            done.append(part.record(at, False))
            yield _frame(done, _SEGMENT)

    return run


def _joined(group: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring segments as one."""
    group = group.sort_values("at")
    counts, steps = _Counts(), []
    for r in group.to_dict("records"):
        if r["rows"]:
            low, high = (None if r[c] is None else int(r[c]) for c in ("low", "high"))
            counts.put({c: int(r[c]) for c in _SUMS}, r["first"], r["last"], low, high)
        steps.append(_as_step(r["moves"]))
    out = counts.record(group["conv"].iloc[0], int(group["at"].iloc[0]))
    return _frame([out | {"moves": _as_records(_between(steps))}], _JOINED)


def _as_text(df: DataFrame) -> DataFrame:
    """Turns as text: pandas would make floating-point numbers of those beside a null."""
    return df.withColumns({c: F.col(c).cast("string") for c in ("low", "high")})


def _one_each(segments: DataFrame, fan_in: int) -> DataFrame:
    """One record for each conversation from its segments, ``fan_in`` neighbours at a time."""
    now = segments.select("conv", "at", *_SUMS, "first", "last", "low", "high", "moves")
    while True:
        nth = F.row_number().over(Window.partitionBy("conv").orderBy("at")) - 1
        places = materialize(now.select("conv", "at", nth.alias("nth")), "places")
        if not (places.agg(F.max("nth")).first()[0] or 0):
            return now
        groups = _as_text(now).join(places.select("conv", "at", F.floor(F.col("nth") / fan_in).alias("_to")), ["conv", "at"])
        now = materialize(groups.groupBy("conv", "_to").applyInPandas(_joined, _JOINED), "joined-segments")


def _finished(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cost and audit of conversations that are one record."""
    for frame in frames:
        done = []
        for r in frame.to_dict("records"):
            cost, audit = search([_as_step(r["moves"])], _NONE, _ENDING)
            done.append(r | {"cost": cost, "audit": audit})
        yield _frame(done, _ENDED)


def _hashes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of conversations whose audit and lines come sorted, in a stream."""
    conv, sha, done = None, None, []
    for frame in frames:
        for name, at, line in frame[["conv", "at", "line"]].itertuples(index=False):
            if name != conv:
                if sha is not None:
                    done.append((conv, sha.end()))
                conv, sha = name, _Digest(line["text"])
            else:
                sha.row(line["initial"], line["first"], int(line["copies"]), line["role"], line["text"])
        yield pd.DataFrame(done, columns=["conv", "sha"], dtype=object)
        done = []
    if sha is not None:
        yield pd.DataFrame([(conv, sha.end())], columns=["conv", "sha"], dtype=object)


# --- the repair ------------------------------------------------------------------------------

def repair(rows: DataFrame, segment: int = SEGMENT, fan_in: int = FAN_IN) -> DataFrame:
    """Repair the conversations of ``rows`` (``conv_id, turn, role, text, n``: a row and how often it is there).

    One row for each ``conv_id`` (a null one too): ``gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256`` of its rows by turn (null first), role and text's digest. ``role`` and ``text`` are not
    null. Rows with ``n`` 0 are not there, but their conversation is: without any row it has zeros, an empty
    audit and the digest of the empty text. Gaps beyond a long are the greatest long. Copies of a row, however
    many, are one row with a number. Other columns are not read.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    named = told_apart(rows.select(key.alias("conv"), "turn", "role", "text", "n"))
    order = ["conv", "turn", "role", "digest"]
    stream = named.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv", F.col("turn").cast("string"), "role", "digest", "blank", "n", "text",
        F.col("text").rlike(_CLOSED).alias("closed"))
    found = materialize(stream.mapInPandas(_segments(segment), _SEGMENT), "segments")

    ready = found.where("audit is not null").drop("at", "moves", "lines")
    cut = found.where("audit is null")
    one = materialize(_as_text(_one_each(cut, fan_in)).mapInPandas(_finished, _ENDED), "one-each")
    header = one.select("conv", F.lit(-1).cast("bigint").alias("at"), F.lit(-1).alias("no"), F.struct(
        F.lit("").alias("initial"), F.lit(False).alias("first"), F.lit(0).cast("bigint").alias("copies"),
        F.lit("").alias("role"), F.col("audit").alias("text")).alias("line"))
    lines = header.unionByName(cut.select("conv", "at", F.posexplode("lines").alias("no", "line")))
    sha = lines.repartition("conv").sortWithinPartitions("conv", "at", "no").select("conv", "at", "line").mapInPandas(
        _hashes, "conv string, sha string")
    out = ready.unionByName(one.join(sha, "conv"))

    long = F.lit((1 << 63) - 1).cast("decimal(21,0)")
    span = (F.col("high").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)") + 1 - F.col("turns")).cast("decimal(21,0)")
    conv_id = F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30)).cast(rows.schema["conv_id"].dataType)
    return out.select(
        conv_id.alias("conv_id"), F.when(F.col("low").isNull(), 0).otherwise(F.least(span, long)).cast("bigint").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))
