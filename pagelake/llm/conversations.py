"""Conversation structure repair by cheapest edits.

A repaired conversation has role initials ``(s?(ua)+)?``.  Rows may be kept (0),
given the other role (2) or deleted (3, required for blank and repeated rows),
empty rows may be inserted (2), and a truncated row that stays adds 1.  Among
the cheapest edits the ASCII-least string of their initials (the audit) wins.

One integer carries both: its high digits are the cost, its low digits, of a
fixed number of octal places, the letters of the audit from the left, zero where
it has ended.  The least integer over the paths of a small graph (rows x the four
states of the pattern) is then the cheapest edit with the least audit; nothing
else is compared.  Two paths that reach the same state over the same rows and
cost alike never have audits where one begins the other, as more letters would
be insertions, which cost; so the smaller one stays smaller whatever follows.

That also makes paths composable.  Rows are sorted over ranges of (conversation,
turn), runs of at most ``SEGMENT`` rows are reduced to their best paths between
states, and a conversation chains its segments, so a very long conversation is
spread over tasks.  Its texts are read once more, sorted and streamed, for the
digest of the result, of which a task holds one batch; the audit is one value.

Defined results: a null role or text is one space, a null conversation id is a
conversation, null turns come first; rows of one turn are ordered by a digest of
role and text; repeated rows are duplicates; a conversation without rows has
zeros, an empty audit and the digest of nothing; an empty table gives an empty
result; texts may have any length; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagelake.llm.common import SPACE_CLASS, WORD_PATTERN, pick, written

SEGMENT = 1024
# Paths remembered per task, by the shape of the rows (memory, not results).
REMEMBERED = 50_000

_START, _SYSTEM, _USER, _DONE = range(4)
# What an initial leads to, and what one more user or assistant row leads to.
_BY_INITIAL = {("s", _START): _SYSTEM, ("u", _START): _USER, ("u", _SYSTEM): _USER, ("u", _DONE): _USER, ("a", _USER): _DONE}
_TURNED = (_USER, _USER, _DONE, _USER)
_KEEP, _REROLE, _DELETE, _INSERT, _CUT = 0, 2, 3, 2, 1
_CODE = {"D": 1, "I": 2, "K": 3, "R": 4}
_TO_DIGITS, _TO_LETTERS = str.maketrans("DIKR", "1234"), str.maketrans("1234", "DIKR")
_LEGAL = {"su", "ua", "au"}

Paths = list  # per state: (weight, letters) or None


def _offer(best: Paths, state: int, weight: int, letters: int) -> None:
    if best[state] is None or weight < best[state][0]:
        best[state] = (weight, letters)


def _with_insertions(best: Paths, width: int) -> Paths:
    """Paths that may end with inserted rows; a fourth would return to a state."""
    for _ in range(3):
        for state, path in enumerate(list(best)):
            if path is not None:
                weight, n = path
                _offer(best, _TURNED[state], weight + (_INSERT << 3 * width) + (_CODE["I"] << 3 * (width - 1 - n)), n + 1)
    return best


def _over_row(best: Paths, shape: str, width: int) -> Paths:
    """Paths over one row; ``shape`` is its initial or ``-``, in upper case or ``+`` if truncated, or ``x`` if it must go."""
    out: Paths = [None] * 4
    initial, cut = shape.lower(), _CUT if shape.isupper() or shape == "+" else 0
    for state, path in enumerate(best):
        if path is None:
            continue
        weight, n = path
        place = 3 * (width - 1 - n)
        _offer(out, state, weight + (_DELETE << 3 * width) + (_CODE["D"] << place), n + 1)
        if shape == "x":
            continue
        _offer(out, _TURNED[state], weight + (_REROLE + cut << 3 * width) + (_CODE["R"] << place), n + 1)
        kept = _BY_INITIAL.get((initial, state))
        if kept is not None:
            _offer(out, kept, weight + (_KEEP + cut << 3 * width) + (_CODE["K"] << place), n + 1)
    return out


def _read(path: tuple[int, int], width: int) -> tuple[int, str]:
    """Cost and audit of a path."""
    weight, n = path
    digits = format(weight & ((1 << 3 * width) - 1), "o").zfill(width)[:n] if n else ""
    return weight >> 3 * width, digits.translate(_TO_LETTERS)


def segment_paths(shapes: str, start: int) -> list[tuple[int, str] | None]:
    """Best ``(cost, audit)`` from ``start`` to each state over the rows, insertions before each row included."""
    width = 4 * len(shapes) + 4
    best: Paths = [None] * 4
    best[start] = (0, 0)
    for shape in shapes:
        best = _over_row(_with_insertions(best, width), shape, width)
    return [None if p is None else _read(p, width) for p in best]


def cheapest(segments: list[list[list]]) -> tuple[int, str]:
    """Cost and audit of a whole conversation from its segments' paths, by state before and state after."""
    width = 4 + sum(max(len(p[1]) for paths in s for p in paths if p is not None) for s in segments)
    best: Paths = [(0, 0), None, None, None]
    for segment in segments:
        out: Paths = [None] * 4
        for before, path in enumerate(best):
            if path is None:
                continue
            weight, n = path
            for after, step in enumerate(segment[before]):
                if step is not None:
                    cost, audit = step
                    letters = int(audit.translate(_TO_DIGITS) or "0", 8) << 3 * (width - n - len(audit))
                    _offer(out, after, weight + (cost << 3 * width) + letters, n + len(audit))
        best = out
    best = _with_insertions(best, width)
    return _read(min(p for p in (best[_START], best[_DONE]) if p is not None), width)


def edits(audit: str) -> list[tuple[str, str | None]]:
    """``(letter, new role)`` per letter: the place in the pattern tells the role that R and I give."""
    role, out, left = None, [], sum(x != "D" for x in audit)
    for letter in audit:
        if letter == "D":
            out.append((letter, None))
            continue
        # an even number of rows is still to come before a user, and an odd one before an assistant
        role = "user" if left % 2 == 0 else "assistant"
        left -= 1
        out.append((letter, None if letter == "K" else role))
    return out


# ---------------------------------------------------------------- damage


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """Rows after the damage that the crc32 of ``conv:turn`` assigns; columns conv_id, turn, role, text."""
    d = pick(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)

    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    d = d.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


# ---------------------------------------------------------------- repair


def _keyed(rows: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    key = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return rows.select("conv_id", "turn", F.unhex(key).alias("key"), role.alias("role"), text.alias("text"))


def _shaped(rows: DataFrame) -> DataFrame:
    """Rows without texts: initial, blank and truncated, and whether a row with its role and text comes earlier."""
    first = F.substring("role", 1, 1)
    slim = rows.select("conv_id", "turn", "key", F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("-")).alias("initial"),
                       (~F.col("text").rlike(WORD_PATTERN)).alias("blank"),
                       (~F.col("text").rlike(rf"[.!?][{SPACE_CLASS}]*\z")).alias("truncated"))
    slim = written(slim, "rows")
    turn = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    again = slim.groupBy("conv_id", "key").agg(F.count(F.lit(1)).alias("n"), F.min(turn).alias("first")).where("n > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("key").alias("k"), F.col("first.turn").alias("first_turn"))
    same = slim["conv_id"].eqNullSafe(again["c"]) & (slim["key"] == again["k"])
    return slim.join(again, same, "left").select(
        "conv_id", "turn", "key", "initial", "blank", "truncated", F.col("k").isNotNull().alias("repeated"),
        F.col("turn").eqNullSafe(F.col("first_turn")).alias("at_first"))


_SEGMENT_COLUMNS = ("part bigint, no bigint, first string, last string, first_turn {t}, last_turn {t}, turns bigint, blank bigint, "
                    "duplicate bigint, truncated bigint, illegal bigint, costs array<bigint>, audits array<string>")
_STATS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def _segments(shaped: DataFrame, segment: int) -> DataFrame:
    """One row per run of a conversation's rows: its counts and its best paths."""
    kind = {f.name: f.dataType.simpleString() for f in shaped.schema.fields}
    ddl = f"conv_id {kind['conv_id']}, " + _SEGMENT_COLUMNS.format(t=kind["turn"])
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    names = ["conv_id", "turn", "key", "initial", "blank", "truncated", "repeated", "at_first"]
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "key")]
    placed = shaped.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known = TaskContext.get().partitionId(), {}

        def paths(shapes: str, start: int) -> list:
            if len(known) > REMEMBERED:
                known.clear()
            found = known.get((shapes, start))
            if found is None:
                found = known[shapes, start] = segment_paths(shapes, start)
            return found

        def closed(no: int, conv, held: list, turns: list, counts: list, begins: bool) -> tuple:
            shapes = "".join(x[1] for x in held)
            steps = [paths(shapes, s) if s == _START or not begins else [None] * 4 for s in range(4)]
            flat = [p for step in steps for p in step]
            initials = "".join(x[0] for x in held)
            illegal = sum(initials[i:i + 2] not in _LEGAL for i in range(len(initials) - 1))
            distinct = sum(t is not None and (i == 0 or t != turns[i - 1]) for i, t in enumerate(turns))
            seen = [t for t in (turns[0], turns[-1])]
            first = next((t for t in turns if t is not None), None) if seen[0] is None else seen[0]
            return (conv, part, no, initials[0], initials[-1], first, seen[1], distinct, *counts, illegal,
                    [None if p is None else p[0] for p in flat], [None if p is None else p[1] for p in flat])

        out, held, turns, counts, no = [], [], [], [0, 0, 0], 0
        conv, before, started, begins = None, None, False, False
        for row in _rows(batches, names):
            c, turn, key, initial, blank, truncated, repeated, at_first = row
            if held and (c != conv or len(held) >= segment):
                out.append(closed(no, conv, held, turns, counts, begins))
                # a conversation that follows another one in this task begins here
                no, begins = no + 1, c != conv
                held, turns, counts = [], [], [0, 0, 0]
                if len(out) >= 1000:
                    yield _batches(out, schema)
                    out = []
            conv, started = c, True
            duplicate = repeated and not blank and not (at_first and before != row[:3])
            before = row[:3]
            gone = blank or duplicate
            held.append((initial, "x" if gone else initial.upper() if truncated and initial != "-" else "+" if truncated else initial))
            turns.append(turn)
            counts[0 if blank else 1 if duplicate else 2] += 1 if gone or truncated else 0
        if started:
            out.append(closed(no, conv, held, turns, counts, begins))
        if out:
            yield _batches(out, schema)

    return placed.mapInArrow(run, ddl)


def _chained(segments: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per conversation: its counts, the cost and the audit."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {kind}, {_STATS}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    everyone = segments.unionByName(ids, allowMissingColumns=True).repartition("conv_id")
    ordered = everyone.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ("conv_id", "part", "no")])
    names = ordered.columns

    def chain(conv, rows: list[tuple]) -> tuple:
        if not rows:
            return (conv, 0, 0, 0, 0, 0, 0, "")
        x = [dict(zip(names, r, strict=True)) for r in rows]
        turns = sum(s["turns"] for s in x) - sum(
            a["last_turn"] is not None and a["last_turn"] == b["first_turn"] for a, b in zip(x, x[1:], strict=False))
        least = next((s["first_turn"] for s in x if s["first_turn"] is not None), None)
        gaps = 0 if least is None else x[-1]["last_turn"] - least + 1 - turns
        illegal = sum(s["illegal"] for s in x) + sum(a["last"] + b["first"] not in _LEGAL for a, b in zip(x, x[1:], strict=False))
        paths = []
        for s in x:
            flat = [None if c is None else (c, a) for c, a in zip(s["costs"], s["audits"], strict=True)]
            paths.append([flat[i:i + 4] for i in range(0, 16, 4)])
        return (conv, gaps, *(sum(s[c] for s in x) for c in ("blank", "duplicate", "truncated")), illegal, *cheapest(paths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, conv, started = [], [], None, False
        for row in _rows(batches, names):
            if started and row[0] != conv:
                out.append(chain(conv, held))
                held = []
                if len(out) >= 5000:
                    yield _batches(out, schema)
                    out = []
            conv, started = row[0], True
            if row[1] is not None:  # rows without a task only name a conversation
                held.append(row)
        if started:
            out.append(chain(conv, held))
        if out:
            yield _batches(out, schema)

    return ordered.mapInArrow(run, ddl)


def _applied(rows: DataFrame, chained: DataFrame, digest: bool) -> DataFrame:
    """The audits carried out on the sorted rows: the digest of each result, or its rows."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    stats = [f.name for f in StructType.fromDDL(_STATS).fields]
    ddl = f"conv_id {kind['conv_id']}, " + (f"{_STATS}, repaired_sha256 string" if digest else "position bigint, role string, text string")
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    both = chained.withColumn("head", F.lit(0)).unionByName(rows.withColumn("head", F.lit(1)), allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ("conv_id", "head", "turn", "key")])
    names = ["conv_id", "head", "role", "text", *stats]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        head, todo, at, made, lines = None, [], 0, None, 0

        def add(role: str, text: str) -> None:
            nonlocal lines, size
            if digest:
                made.update(f"{'' if not lines else chr(10)}{role}:{text}".encode())
            else:
                out.append((head[0], lines, role, text))
                size += len(text)
            lines += 1

        def insertions() -> None:
            nonlocal at
            while at < len(todo) and todo[at][0] == "I":
                add(todo[at][1], "")
                at += 1

        def finish() -> None:
            if head is not None:
                insertions()
                if digest:
                    out.append((head[0], *head[4:], made.hexdigest()))

        for row in _rows(batches, names):
            if row[1] == 0:
                finish()
                head, at, made, lines = row, 0, hashlib.sha256(), 0
                todo = edits(row[-1])
            else:
                insertions()
                letter, role = todo[at]
                at += 1
                if letter != "D":
                    add(role or row[2], row[3])
            if len(out) >= 5000 or size > 8_000_000:
                yield _batches(out, schema)
                out, size = [], 0
        finish()
        if out:
            yield _batches(out, schema)

    return ordered.select(*names).mapInArrow(run, ddl)


def _repair(rows: DataFrame, ids: DataFrame, segment: int, digest: bool) -> DataFrame:
    keyed = _keyed(rows)
    return _applied(keyed, _chained(_segments(_shaped(keyed), segment), ids.distinct()), digest)


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` per conversation."""
    d = pick(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    return _repair(d, d.select("conv_id"), segment, True)


def repaired_rows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """The repaired conversations: ``(conv_id, position, role, text)``."""
    d = pick(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    return _repair(d, d.select("conv_id"), segment, False)


def repair_damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """``repair`` of the damaged rows, with a row for every conversation there was before the damage."""
    rows = damaged(conversations, conv_col, turn_col, role_col, text_col)
    return _repair(rows, pick(conversations, conv_id=conv_col), segment, True)
