"""Repair of conversation structure: the cheapest edits that make the roles ``(s?(ua)+)?``, by dynamic programming over time.

A conversation's rows stand in order of turn (nulls first; ties: role, text). A row is blank (no character but ASCII white space), else a
duplicate (its role and text were seen earlier), else truncated (its last such character is no ``.``, ``!`` or ``?``), or sound.
Edits: Keep (0), Rerole to user or assistant (1), Delete (2; blank and duplicate rows must go), Insert a user or assistant row with an empty
text anywhere (5); a truncated row that stays adds 5. Of the cheapest edits, those whose initials are least in ASCII order.

Four states tell what may follow: the start, after the system row, after a user row, after an assistant row. In a state each
letter leads to one other state, so initials fix the repaired rows, and the least letter on a cheapest path is the next one.

1. Rows are dealt by (conversation, 1,024 turns) and become one byte each, role and fault. What was seen earlier is found by digests
   of conversation, role and text, whose sums are joined back without texts.
2. The bytes of a conversation come together. Conversations are bucketed by length (powers of two); a bucket is a tensor [time,
   conversation], and each step from the last turn to the first updates all conversations' costs of all states at once. The costs are
   kept, and the edits are traced forwards, all conversations a step. A conversation beyond 1,024 rows is cut into pieces,
   columns of the same tensor: 4 x 4 costs of each piece are composed, then each piece is traced from each state, and the pieces' ends
   tell which trace holds.
3. Rows are read as a stream beside their conversation's edits, and the repaired rows are hashed as they pass.

Step 3 brings one conversation's rows into one task, sorted by Spark and never held: a hash of the whole can't be split. Nulls: a null
text or role is one space; null conversation ids are one conversation; null turns come first and are no turn for ``gaps``. Equal rows are
duplicates of one another. A conversation without rows after damage gets zeros, no edits and the hash of nothing; an empty table gives an
empty one. Texts of any length are read whole. Columns besides the four are left out, so their names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import drop_table, join_spread, materialize

TURNS = 1_024
CELLS = 250_000
FAR = 1 << 40
RULES = {"rerole": 1, "delete": 2, "insert": 5, "truncated": 5}
#: A row's byte: 4 * role (by initial) + fault.
ROLES, SOUND, TRUNCATED, BLANK, DUPLICATE = "sua", 0, 1, 2, 3
_NO_ROW = 16
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = np.array([USER, USER, ASSISTANT, USER])  # what an inserted or reroled row leads to
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By byte: costs of keeping (by state), the state it leads to, and the cost of reroling."""
    keep, to, rerole = np.full((17, 4), FAR), np.zeros((17, 4), np.int64), np.full(17, FAR)
    for role in range(4):
        for fault in (SOUND, TRUNCATED):
            code, more = 4 * role + fault, RULES["truncated"] * (fault == TRUNCATED)
            rerole[code] = RULES["rerole"] + more
            for state, then in _KEPT.get(ROLES[role : role + 1], {}).items():
                keep[code, state], to[code, state] = more, then
    return keep, to, rerole


_KEEP, _TO, _REROLE = _tables()
#: What it costs to end in a state: nothing, or the rows that must be inserted.
_END = np.array([0, 2 * RULES["insert"], RULES["insert"], 0])


def _step(code: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Least costs [column, state, ...] before the rows ``code``, from those after them."""
    wide = (slice(None), slice(None)) + (None,) * (after.ndim - 2)
    deleted = RULES["delete"] + after
    kept = _KEEP[code][wide] + np.take_along_axis(after, _TO[code][wide], 1)
    reroled = _REROLE[code][(slice(None), None) + (None,) * (after.ndim - 2)] + after[:, _NEXT]
    best = np.minimum(np.minimum(deleted, kept), reroled)
    for _ in range(3):  # at most three rows are inserted in one place
        best = np.minimum(best, RULES["insert"] + best[:, _NEXT])
    real = (code != _NO_ROW)[(slice(None), None) + (None,) * (after.ndim - 2)]
    return np.where(real, best, after)


def costs(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs [time + 1, column, state] of the rest of each column of ``codes`` [time, column], which ends at the costs ``end``."""
    out = np.empty((len(codes) + 1, *end.shape), np.int64)
    out[-1] = end
    for t in range(len(codes) - 1, -1, -1):
        out[t] = _step(codes[t], out[t + 1])
    return out


def trace(codes: np.ndarray, cost: np.ndarray, state: np.ndarray, last: bool) -> tuple[list[bytes], np.ndarray]:
    """The least initials of each column's cheapest edits from ``state``, and the state they end in. ``last``: nothing follows."""
    time, n = codes.shape
    letters = np.zeros((time + 1, 4, n), np.uint8)
    columns = np.arange(n)
    state = state.copy()
    for t in range(time):
        code = codes[t]
        open_ = code != _NO_ROW
        for slot in range(4):
            now, then = cost[t], cost[t + 1]
            here, to = now[columns, state], _TO[code, state]
            # the first letter in ASCII order whose cost adds up
            delete = open_ & (RULES["delete"] + then[columns, state] == here)
            insert = open_ & ~delete & (RULES["insert"] + now[columns, _NEXT[state]] == here)
            keep = open_ & ~delete & ~insert & (_KEEP[code, state] + then[columns, to] == here)
            rerole = open_ & ~delete & ~insert & ~keep
            letters[t, slot] = 68 * delete + 73 * insert + 75 * keep + 82 * rerole
            state = np.where(keep, to, np.where(insert | rerole, _NEXT[state], state))
            open_ = insert
            if not open_.any():
                break
    if last:
        for slot in range(2):
            open_ = (state == SYSTEM) | (state == USER)
            letters[time, slot] = 73 * open_
            state = np.where(open_, _NEXT[state], state)
    flat = letters.reshape(-1, n).T
    return [row[row > 0].tobytes() for row in flat], state


def _columns(rows: list[np.ndarray], time: int) -> np.ndarray:
    out = np.full((time, len(rows)), _NO_ROW, np.int64)
    for i, r in enumerate(rows):
        out[: len(r), i] = r
    return out


def repair_bucket(rows: list[np.ndarray]) -> list[tuple[int, str]]:
    """Cost and initials of each conversation of a bucket (bytes of its rows), all of them a step at a time."""
    codes = _columns(rows, max(map(len, rows)))
    cost = costs(codes, np.tile(_END, (len(rows), 1)))
    letters, _ = trace(codes, cost, np.full(len(rows), START), True)
    return [(int(c), x.decode()) for c, x in zip(cost[0, :, START], letters, strict=True)]


def repair_long(row: np.ndarray, piece: int = TURNS) -> tuple[int, str]:
    """Cost and initials of one long conversation, its pieces side by side."""
    pieces = [row[i : i + piece] for i in range(0, len(row), piece)]
    batches = [pieces[i : i + max(1, CELLS // piece)] for i in range(0, len(pieces), max(1, CELLS // piece))]
    between = []  # costs [piece, state, state at its end]
    for batch in batches:
        now = np.tile(np.where(np.eye(4, dtype=bool), 0, FAR), (len(batch), 1, 1))
        codes = _columns(batch, piece)
        for t in range(piece - 1, -1, -1):
            now = _step(codes[t], now)
        between.append(now)
    steps = np.concatenate(between)
    ends = np.empty((len(pieces) + 1, 4), np.int64)
    ends[-1] = _END
    for i in range(len(pieces) - 1, -1, -1):
        ends[i] = np.minimum((steps[i] + ends[i + 1]).min(1), FAR)
    out, state, done = [], START, 0
    for batch in batches:
        codes, end = _columns(batch, piece), ends[done + 1 : done + 1 + len(batch)]
        cost = costs(codes, end)
        wide = np.repeat(np.arange(len(batch)), 4)
        final = done + len(batch) == len(pieces)
        found, to = trace(codes[:, wide], cost[:, wide], np.tile(np.arange(4), len(batch)), False)
        for i in range(len(batch)):
            if final and i == len(batch) - 1:
                letters, _ = trace(codes[:, i : i + 1], cost[:, i : i + 1], np.array([state]), True)
                out.append(letters[0])
            else:
                out.append(found[4 * i + state])
                state = int(to[4 * i + state])
        done += len(batch)
    return int(ends[0, START]), b"".join(out).decode()


def damaged(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text): the rows, damaged by the checksum of their id and turn."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.pmod(F.crc32(F.concat(said(id_col), F.lit(":"), said(turn_col)).cast("binary")), F.lit(20))
    text = F.when(F.col("_w") == 1, "").when(F.col("_w") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_w") == 4, "user").otherwise(F.col("role"))
    rows = conversations.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"), what.alias("_w")).where("_w <> 0")
    times = F.explode(F.when(F.col("_w") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), times.alias("_t")).drop("_t")


def _seen_earlier(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, key) of the rows whose role and text an earlier turn of the conversation has; no texts."""
    light = materialize(rows.groupBy("key", "conv", "role", "turn").agg(F.count(F.lit(1)).alias("_n")).drop("_n"), "repair-keys")
    first = light.groupBy("key").agg(F.min(F.struct("turn")).alias("_first"), F.count(F.lit(1)).alias("_turns")).where("_turns > 1")
    late = join_spread(light, first, "key", "_turns", light.count()).where("turn is not null and (_first.turn is null or turn > _first.turn)")
    return late.select("conv", "turn", "role", "key")


def _coded(rows: DataFrame) -> DataFrame:
    """(conv, chunk, seq, codes, low, high, turns): the rows' bytes in order; turns of a chunk are counted once."""
    conv = F.when(F.col("conv").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("conv").cast("string")))
    key = F.unhex(F.md5(F.concat(F.length(conv).cast("string"), F.lit(":"), conv, F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*+\z", 1)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    fault = F.when(blank, BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    keyed = rows.withColumn("key", key)
    told = keyed.select("*", role.alias("_role"), fault.alias("_fault"), F.lit(1).alias("kind"))
    marks = _seen_earlier(keyed).withColumns({"text": F.lit(None).cast("string"), "_role": F.lit(0), "_fault": F.lit(0), "kind": F.lit(0)})
    chunk = F.floor(F.col("turn") / TURNS)
    dealt = told.unionByName(marks).withColumn("chunk", chunk).repartition("conv", "chunk")
    equal = Window.partitionBy("conv", "chunk", "turn", "role", "key").orderBy("kind")
    # the first of equal rows is no duplicate unless a mark comes before it
    dealt = dealt.withColumn("_again", F.row_number().over(equal) > 1).where("kind = 1")
    code = (F.col("_role") * 4 + F.when((F.col("_fault") != BLANK) & F.col("_again"), DUPLICATE).otherwise(F.col("_fault"))).cast("byte")
    ordered = dealt.withColumn("code", code).sortWithinPartitions("conv", "chunk", "turn", "role", "text").select("conv", "chunk", "turn", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, turn_before, seq = object(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            where = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            turns, codes = batch.column(2).to_pylist(), batch.column(3).to_numpy().tobytes()
            cuts = [0, *(i for i in range(1, len(where)) if where[i] != where[i - 1]), len(where)]
            out = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if where[a] != before:
                    before, turn_before, seq = where[a], None, 0
                known = turns[a:b] if where[a][1] is not None else []
                count = sum(x != y for x, y in zip(known, [turn_before, *known], strict=False))
                out.append((where[a][1], seq, codes[a:b], known[0] if known else None, known[-1] if known else None, count))
                turn_before, seq = (known[-1] if known else None), seq + 1
            types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cuts[:-1])), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True))], names=["conv", "chunk", "seq", "codes", "low", "high", "turns"])

    fields = "chunk long, seq long, codes binary, low long, high long, turns long"
    return ordered.mapInArrow(run, T.StructType([rows.schema["conv"], *T.StructType.fromDDL(fields).fields]))


_FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _edits(coded: DataFrame) -> DataFrame:
    """Counts, cost and edits of each conversation from its bytes."""
    ordered = coded.repartition("conv").sortWithinPartitions("conv", "chunk", "seq")
    types = [to_arrow_type(coded.schema["conv"].dataType), *[pa.int64()] * 6, pa.string()]

    def counts(row: np.ndarray, low: int | None, high: int | None, turns: int) -> tuple:
        fault, role = row % 4, row // 4
        # legal neighbours: system user, user assistant, assistant user
        legal = (role[1:] == 1) & ((role[:-1] == 0) | (role[:-1] == 2)) | (role[1:] == 2) & (role[:-1] == 1)
        gaps = 0 if low is None else high - low + 1 - turns
        return gaps, *(int((fault == f).sum()) for f in (BLANK, DUPLICATE, TRUNCATED)), int((~legal).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[int, list] = {}

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv", *(f.split()[0] for f in _FOUND.split(", "))])

        def flush(size: int) -> pa.RecordBatch:
            held = buckets.pop(size)
            return table([(conv, *more, *edit) for (conv, _, more), edit in zip(held, repair_bucket([r for _, r, _ in held]), strict=True)])

        def finish(conv, parts: list[bytes], low, high, turns) -> Iterator[pa.RecordBatch]:
            row = np.frombuffer(b"".join(parts), np.int8).astype(np.int64) if sum(map(len, parts)) <= TURNS else np.frombuffer(b"".join(parts), np.int8)
            more = counts(row, low, high, turns)
            if not len(row):
                yield table([(conv, *more, 0, "")])
            elif len(row) > TURNS:
                yield table([(conv, *more, *repair_long(row))])
            else:
                size = 1 << (len(row) - 1).bit_length()
                buckets.setdefault(size, []).append((conv, row, more))
                if len(buckets[size]) * size >= CELLS:
                    yield flush(size)

        now, state = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if state is None or r["conv"] != now:
                    if state is not None:
                        yield from finish(now, *state)
                    now, state = r["conv"], [[], None, None, 0]
                state[0].append(r["codes"])
                if r["low"] is not None:
                    state[1:] = [r["low"] if state[1] is None else state[1], r["high"], state[3] + r["turns"]]
        if state is not None:
            yield from finish(now, *state)
        for size in list(buckets):
            yield flush(size)

    return ordered.mapInArrow(run, T.StructType([coded.schema["conv"], *T.StructType.fromDDL(_FOUND).fields]))


def _hashed(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits`` with the hash of each conversation's repaired rows."""
    names = [c for c in edits.columns if c != "conv"]
    none = {c: F.lit(None).cast(edits.schema[c].dataType) for c in names}
    lines = rows.withColumns({"kind": F.lit(1), **none})
    heads = edits.withColumns({"kind": F.lit(0), "turn": F.lit(None).cast(rows.schema["turn"].dataType), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    ordered = lines.unionByName(heads).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "text").select("conv", "kind", "role", "text", *names)
    schema = T.StructType([*edits.schema.fields, T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, hasher, letters, at, state, began = None, None, "", 0, START, False

        def add(role: str, text: str) -> None:
            nonlocal began
            hasher.update((("\n" if began else "") + role + ":" + text).encode())
            began = True

        def insert() -> None:
            nonlocal at, state
            while at < len(letters) and letters[at] == "I":
                state, at = int(_NEXT[state]), at + 1
                add("assistant" if state == ASSISTANT else "user", "")

        def close() -> pa.RecordBatch:
            insert()
            return pa.RecordBatch.from_arrays([*head, pa.array([hasher.hexdigest()])], names=schema.names)

        for batch in batches:
            kinds, roles, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            done = []
            for i, kind in enumerate(kinds):
                if kind == 0:
                    if head is not None:
                        done.append(close())
                    head = [batch.column(c).slice(i, 1) for c in (0, *range(4, batch.num_columns))]
                    hasher, letters, at, state, began = hashlib.sha256(), head[-1][0].as_py(), 0, START, False
                    continue
                insert()
                letter, role, at = letters[at], roles[i], at + 1
                if letter == "D":
                    continue
                if letter == "R":
                    state = int(_NEXT[state])
                    role = "assistant" if state == ASSISTANT else "user"
                else:
                    state = _KEPT[role[0]][state]
                add(role, texts[i].as_py())
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if head is not None:
            yield close()

    return ordered.mapInArrow(run, schema)


def repair(conversations: DataFrame, rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Faults, cost, edits and the hash of the repaired rows of each id of ``conversations``, from its ``rows`` (conv, turn, role, text)."""
    ids = conversations.select(F.col(id_col).alias("conv")).distinct()
    coded = _coded(rows)
    empty: dict[str, Column] = {f.name: F.lit(None).cast(f.dataType) for f in coded.schema.fields if f.name != "conv"} | {"codes": F.lit(b""), "turns": F.lit(0).cast("long"), "seq": F.lit(-1).cast("long")}
    edits = materialize(_edits(coded.unionByName(ids.withColumns(empty))), "repair-edits")
    return _hashed(rows, edits).withColumnRenamed("conv", id_col)


def damage_and_repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """:func:`repair` of the rows that :func:`damaged` leaves."""
    return repair(conversations, damaged(conversations, id_col, turn_col, role_col, text_col), id_col)
