"""Conversation structure repair by lightest derivations.

The rows of a conversation are edited so that their role initials read
``(s?(ua)+)?``. An item says that the first rows are edited and leave the
automaton of that pattern in a state; its weight is the cost and the audit, the
initials of the edits so far. Deductions append an edit, or join an item with
that of a following stretch of rows. Items wait on an agenda and are popped
lightest first (Knuth's generalisation of Dijkstra's search), so that a popped
item is final; the goal is that of all rows in an accepting state.

Weights are compared by cost, then by audit as ASCII text. Appending never makes
a weight lighter, and it keeps the order of two weights of one item: audits of
equal cost that edit the same rows are never beginnings of each other, as an
inserted row costs something. So the deductions are superior and monotone, which
the agenda needs. From each state one role only can be inserted or given, so the
audit alone tells the repaired rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxframe.llm.text import staged

# Fixed costs of the edits, of a row that must go, and of leaving a truncated row.
KEEP, REROLE, DELETE, INSERT, TRUNCATED_STAYS = 0, 2, 3, 2, 1
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
# States: nothing yet, behind s, behind u, behind a. Kept initials lead from state to state; new rows take the role that fits.
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FITS = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
ACCEPTING = (START, ASSISTANT)
#: White space that makes no row.
SPACE = "\t\n\x0b\x0c\r "
#: Rows and characters of a stretch that is edited in one piece. Longer conversations are joined from stretches, with the same result.
STRETCH_ROWS, STRETCH_CHARS = 512, 4 << 20

Weight = tuple[int, str]
Item = tuple[int, str, tuple]


def lightest(rows: list[tuple[str, int]], start: int, goal: tuple[int, ...] | None = None) -> dict[int, Weight]:
    """Lightest weights of all rows edited, by end state, from ``start``. ``rows`` hold role initial and fault.

    With ``goal`` states the agenda ends at the first of them it pops, else when it is empty.
    """
    n, final, ends = len(rows), set(), {}
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    while agenda:
        cost, audit, at, state = heappop(agenda)
        if (at, state) in final:
            continue
        final.add((at, state))
        if at == n:
            ends[state] = (cost, audit)
            if goal and state in goal:
                return {state: ends[state]}
        role_state = FITS[state][1]
        if (at, role_state) not in final:
            heappush(agenda, (cost + INSERT, audit + "I", at, role_state))
        if at == n:
            continue
        initial, fault = rows[at]
        heappush(agenda, (cost + DELETE, audit + "D", at + 1, state))
        if fault not in (BLANK, DUPLICATE):
            stays = cost + (TRUNCATED_STAYS if fault == TRUNCATED else 0)
            kept = STEP.get((state, initial))
            if kept is not None:
                heappush(agenda, (stays + KEEP, audit + "K", at + 1, kept))
            heappush(agenda, (stays + REROLE, audit + "R", at + 1, role_state))
    return ends


def join_stretch(before: dict[int, Item], table: dict[tuple[int, int], Weight]) -> tuple[str, dict[int, Item]]:
    """Items behind one more stretch: every item before it with every weight of the stretch that begins in its state, lightest first.

    An item carries the states it had at the stretches, newest first. What all
    audits begin with is taken off them and returned, so they stay short.
    """
    agenda: list[tuple[int, str, int, int, tuple]] = []
    for p, (cost, audit, path) in before.items():
        for (start, end), (more, edits) in table.items():
            if start == p:
                heappush(agenda, (cost + more, audit + edits, end, len(agenda), (p, path)))
    final: dict[int, Item] = {}
    while agenda:
        cost, audit, end, _, path = heappop(agenda)
        final.setdefault(end, (cost, audit, path))
    shared = commonprefix([audit for _, audit, _ in final.values()])
    return shared, {q: (cost, audit[len(shared):], path) for q, (cost, audit, path) in final.items()}


def repaired(rows: list[tuple[str, str]], audit: str, state: int) -> tuple[list[str], int]:
    """``role:text`` of the rows (role, text) that an audit leaves, from a state, and the state behind them."""
    out, at = [], 0
    for edit in audit:
        if edit == "I":
            role, state = FITS[state]
            out.append(f"{role}:")
            continue
        role, text = rows[at]
        at += 1
        if edit == "D":
            continue
        if edit == "K":
            state = STEP[state, role[:1]]
        else:
            role, state = FITS[state]
        out.append(f"{role}:{text}")
    return out, state


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) after damage by crc32 of ``conv_id:turn``, modulo 20; ``copies`` is 0 where a row is dropped, 2 where it is repeated."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    hurt = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), hurt.alias("hurt")).select(
        "conv_id", "turn", F.when(F.col("hurt") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hurt").isin(0, 1), "").when(F.col("hurt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("hurt") == 0, 0).when(F.col("hurt") == 3, 2).otherwise(1).cast("bigint").alias("copies"))


def _place() -> Column:
    """A turn's place: NULL before all numbers."""
    return F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))


def _judged(rows: DataFrame) -> DataFrame:
    """Distinct rows with copies, whether the first of them is the first of its role and text, and their fault otherwise."""
    # Copies are added up before anything is exchanged. Dropped rows stay as one row of their conversation, which may have no other.
    rows = rows.withColumn("turn", F.when(F.col("copies") > 0, F.col("turn"))).withColumn("role", F.when(F.col("copies") > 0, F.col("role"))).withColumn(
        "text", F.when(F.col("copies") > 0, F.col("text")))
    each = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    each = each.withColumn("text_key", F.unhex(F.sha2("text", 256)))
    tail = F.rtrim(F.col("text"), F.lit(SPACE))
    each = each.withColumn("fault", F.when(tail == "", BLANK).when(~F.substring(tail, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(NO_FAULT))
    first = each.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text_key").alias("k")).agg(F.min(_place()).alias("first"))
    met = each.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("role").eqNullSafe(F.col("r")) & F.col("text_key").eqNullSafe(F.col("k")), "left")
    return met.withColumn("opens", _place().eqNullSafe(F.col("first"))).select("conv_id", "turn", "role", "text", "copies", "fault", "opens", "text_key")


class _Stretch:
    """Consecutive rows of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.rows, self.faults, self.turns, self.chars = conv_id, [], [], [], 0

    def figures(self) -> dict:
        known = [t for t in self.turns if t is not None]  # in ascending order
        initials = [r[:1] for r, _ in self.rows]
        pairs = [a + b for a, b in zip(initials, initials[1:])]
        return {
            "conv_id": self.conv_id, "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "turns": len(set(known)),
            "blank": self.faults.count(BLANK), "duplicate": self.faults.count(DUPLICATE), "truncated": self.faults.count(TRUNCATED),
            "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "head": initials[0] if initials else None, "tail": initials[-1] if initials else None,
        }

    def items(self) -> list[tuple[str, int]]:
        return [(r[:1], f) for (r, _), f in zip(self.rows, self.faults)]


_FIGURES = [("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal")], ("head", pa.string()), ("tail", pa.string())]
_ITEMS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_STRETCHES = pa.schema([("part", pa.int32()), ("number", pa.int64()), *_FIGURES, ("cost", pa.int64()), ("audit", pa.string()), ("sha", pa.string()), ("items", _ITEMS),
                        ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
STRETCHES = (
    "part int, number bigint, conv_id bigint, first_turn bigint, last_turn bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, "
    "cost bigint, audit string, sha string, items array<struct<start: int, end: int, cost: bigint, audit: string>>, roles array<string>, texts array<string>"
)
RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _sha(rows: list[str]) -> str:
    return hashlib.sha256("\n".join(rows).encode("utf-8", "surrogatepass")).hexdigest()


def _stretches(ordered: DataFrame, most_rows: int, most_chars: int) -> DataFrame:
    """Sorted rows as one row per conversation, with its result, or per stretch where it is long or may go on in another partition (sha is NULL there)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out, size = TaskContext.get().partitionId(), 0, [], 0
        now: _Stretch | None = None
        whole = False  # whether the current conversation began behind another one of this partition and is in one stretch so far

        def closed(s: _Stretch, complete: bool) -> dict:
            nonlocal number, size
            number += 1
            row = {"part": part, "number": number, **s.figures()}
            size += s.chars + len(s.rows)
            if complete:
                (state, (cost, audit)), = lightest(s.items(), START, ACCEPTING).items()
                return row | {"cost": cost, "audit": audit, "sha": _sha(repaired(s.rows, audit, START)[0])}
            items = s.items()
            found = [{"start": p, "end": q, "cost": c, "audit": a} for p in FITS for q, (c, a) in lightest(items, p).items()]
            return row | {"items": found, "roles": [r for r, _ in s.rows], "texts": [t for _, t in s.rows]}

        for b in source:
            for conv_id, turn, role, text, copies, fault, opens in zip(*[b.column(i).to_pylist() for i in range(7)]):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        out.append(closed(now, whole))
                    whole = now is not None
                    now = _Stretch(conv_id)
                for i in range(copies):
                    if len(now.rows) >= most_rows or now.chars >= most_chars:
                        out.append(closed(now, False))
                        now, whole = _Stretch(conv_id), False
                    now.rows.append((role, text))
                    now.faults.append(DUPLICATE if fault != BLANK and (i or not opens) else fault)
                    now.turns.append(turn)
                    now.chars += len(text)
                    if size > most_chars:
                        yield pa.RecordBatch.from_pylist(out, _STRETCHES)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, _STRETCHES)
                out, size = [], 0
        if now is not None:  # the next partition may go on with it
            out.append(closed(now, False))
        if out:
            yield pa.RecordBatch.from_pylist(out, _STRETCHES)

    return ordered.mapInArrow(run, STRETCHES)


_JOINED = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()),
                     ("choices", pa.list_(pa.struct([("part", pa.int32()), ("number", pa.int64()), ("state", pa.int32()), ("audit", pa.string())])))])
JOINED = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
    "choices array<struct<part: int, number: bigint, state: int, audit: string>>"
)


def _joined(stretches: DataFrame) -> DataFrame:
    """Conversations of several stretches, which come sorted: figures, audit, and the state and audit chosen for each stretch. Texts are not needed."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, items, total, tables, begun = None, None, None, None, None

        def finished() -> pa.RecordBatch:
            cost, audit, state = min((c, a, q) for q, (c, a, _) in items.items() if q in ACCEPTING)
            audit, path = "".join([*begun, audit]), items[state][2]
            starts = []
            while path:
                starts.append(path[0])
                path = path[1]
            starts.reverse()
            chosen = [{"part": t[0], "number": t[1], "state": p, "audit": t[2][p, q][1]} for t, p, q in zip(tables, starts, [*starts[1:], state])]
            gaps = total["last_turn"] - total["first_turn"] + 1 - total["turns"] if total["first_turn"] is not None else 0
            return pa.RecordBatch.from_pylist([{**{c: total[c] for c in ("conv_id", "blank", "duplicate", "truncated", "illegal")}, "gaps": gaps, "cost": cost, "audit": audit, "choices": chosen}], _JOINED)

        for b in source:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                table = {(x["start"], x["end"]): (x["cost"], x["audit"]) for x in row["items"]}
                if items is None or row["conv_id"] != conv:
                    if items is not None:
                        yield finished()
                    conv, items, total, tables, begun = row["conv_id"], {START: (0, "", ())}, None, [], []
                shared, items = join_stretch(items, table)
                begun.append(shared)
                tables.append((row["part"], row["number"], table))
                if total is None:
                    total = row
                    continue
                if row["head"] is not None:
                    if total["tail"] is not None:
                        total["illegal"] += total["tail"] + row["head"] not in ("su", "ua", "au")
                    total["tail"] = row["tail"]
                for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                    total[c] += row[c]
                if row["first_turn"] is not None:
                    total["turns"] -= total["last_turn"] == row["first_turn"]  # a turn cut in two
                    total["first_turn"] = row["first_turn"] if total["first_turn"] is None else total["first_turn"]
                    total["last_turn"] = row["last_turn"]
        if items is not None:
            yield finished()

    return stretches.mapInArrow(run, JOINED)


def _written(chosen: DataFrame) -> DataFrame:
    """The repaired rows of each stretch as one text, NULL where none is left."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                lines, _ = repaired(list(zip(row["roles"], row["texts"])), row["audit"], row["state"])
                yield pa.RecordBatch.from_pylist([{"conv_id": row["conv_id"], "part": row["part"], "number": row["number"], "lines": "\n".join(lines).encode("utf-8", "surrogatepass") if lines else None}],
                                                 pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("number", pa.int64()), ("lines", pa.binary())]))

    return chosen.mapInArrow(run, "conv_id bigint, part int, number bigint, lines binary")


def _hashed(written: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's texts, which come sorted; one text is held at a time."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, any_line, seen = None, None, False, False
        schema = pa.schema([("conv_id", pa.int64()), ("sha", pa.string())])
        for b in source:
            for conv_id, lines in zip(b.column(0).to_pylist(), b.column(1)):
                if not seen or conv_id != conv:
                    if seen:
                        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "sha": sha.hexdigest()}], schema)
                    conv, sha, any_line, seen = conv_id, hashlib.sha256(), False, True
                if lines.is_valid:
                    if any_line:
                        sha.update(b"\n")
                    sha.update(lines.as_py())
                    any_line = True
        if seen:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "sha": sha.hexdigest()}], schema)

    return written.mapInArrow(run, "conv_id bigint, sha string")


def repair_conversations(rows: DataFrame, most_rows: int = STRETCH_ROWS, most_chars: int = STRETCH_CHARS) -> DataFrame:
    """Faults and the cheapest repair of each conversation of ``rows`` (conv_id, turn, role, text, copies).

    ``copies`` says how often a row stands there; a conversation whose rows all
    have 0 gives zeros, an empty audit and the empty text's digest. Rows go by
    turn, NULL first; rows of one turn by role and SHA-256 of the text. A NULL conv_id is a conversation of its own; NULL roles and texts count
    as one space. Other columns are not read. An empty table gives an empty result.

    Copies are added up before the first exchange, and the first of equal rows is
    found by a partial aggregate. A range exchange by conversation, turn, role and
    text then divides conversations of any size; each task edits its stretches,
    and only the weights of stretches meet per conversation. Texts move again for
    conversations of several stretches alone. Their digest is the one thing that
    has to go through all texts of a conversation in turn, one stretch at a time.
    """
    judged = _judged(rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copies"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text_key")]
    stretches = staged(_stretches(judged.repartitionByRange(*order).sortWithinPartitions(*order), most_rows, most_chars))
    gaps = F.when(F.col("first_turn").isNull(), F.lit(0)).otherwise(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).cast("bigint")
    done = stretches.filter("sha IS NOT NULL").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))
    parts = stretches.filter("sha IS NULL")
    light = parts.select("conv_id", "part", "number", "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal", "head", "tail", "items")
    joined = staged(_joined(light.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")))
    choices = joined.selectExpr("inline(choices)").withColumnsRenamed({"part": "p", "number": "k"})
    chosen = parts.select("conv_id", "part", "number", "roles", "texts").join(choices, (F.col("part") == F.col("p")) & (F.col("number") == F.col("k")))
    written = _written(chosen.select("conv_id", "part", "number", "roles", "texts", "state", "audit"))
    hashes = _hashed(written.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").select("conv_id", "lines")).withColumnRenamed("conv_id", "c")
    rest = joined.join(hashes, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))
    return done.union(rest)

