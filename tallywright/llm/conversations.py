"""Structure repair of conversations by the cheapest edits, in linear space.

The roles of a repaired conversation read `(s?(ua)+)?`. Four states suffice: nothing
yet, after system, after user, after assistant. An edit consumes a row (K keep, R other
role, D delete) or adds one (I); its letter and the state before give the state behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from tallywright.llm import tables
from tallywright.session import ship

ship(__name__)

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
PIECE_ROWS, PIECE_BYTES = 1 << 16, 1 << 24
SPACE = " \t\n\x0b\x0c\r"
_FAR = 1 << 60
_SYSTEM, _USER, _ASSISTANT = 1, 2, 3
_INITIAL = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}
_GONE, _OPEN = 4, 8  # bits of a row's code beside its initial: to delete, truncated
_LEGAL = {(_SYSTEM, _USER), (_USER, _ASSISTANT), (_ASSISTANT, _USER)}
# states that may end, and what inserts lead there otherwise
_CLOSING = [(0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, "")]

Item = tuple[list[list[int]], list[list]]  # cost and order key from state to state


def _next(state: int, letter: str, initial: int) -> int | None:
    """The state behind an edit, or None where it is not allowed."""
    if letter == "D":
        return state
    if letter == "K":
        fits = {_SYSTEM: state == 0, _USER: state != _USER, _ASSISTANT: state == _USER}
        return initial if fits.get(initial) else None
    return _ASSISTANT if state == _USER else _USER  # I and R


def _row_item(code: int) -> Item:
    """Cheapest way over one row between all states, inserts in front of it included."""
    cost = [[_FAR] * 4 for _ in range(4)]
    keys = [["~"] * 4 for _ in range(4)]
    kept = TRUNCATED if code & _OPEN else 0
    prices = {"D": DELETE} if code & _GONE else {"D": DELETE, "K": KEEP + kept, "R": REROLE + kept}
    for begin in range(4):
        state = begin
        for inserts in range(3):
            for letter, price in prices.items():
                end = _next(state, letter, code & 3)
                if end is not None:
                    way = (inserts * INSERT + price, "I" * inserts + letter)
                    if way < (cost[begin][end], keys[begin][end]):
                        cost[begin][end], keys[begin][end] = way
            state = _next(state, "I", 0)
    return cost, keys


_ROWS = [_row_item(code) for code in range(16)]


def _ahead(items: Sequence[Item], low: int, high: int, start: int) -> tuple[list[int], list[int]]:
    """Cost of reaching each state from `start`, and the order of the least ways there.

    Ways over the same rows end with an edit that consumes the last one, so none begins
    another one, and the order of two ways never changes by what follows.
    """
    cost, rank = [_FAR] * 4, [0, 1, 2, 3]
    cost[start] = 0
    for i in range(low, high):
        price, keys = items[i]
        live = [x for x in range(4) if cost[x] < _FAR]
        best = [min([(cost[x] + price[x][t], rank[x], keys[x][t]) for x in live]) for t in range(4)]
        cost = [min(b[0], _FAR) for b in best]
        order = sorted(range(4), key=lambda t: best[t][1:])
        rank = [order.index(t) for t in range(4)]
    return cost, rank


def _behind(items: Sequence[Item], low: int, high: int, end: int) -> list[int]:
    """Cost of reaching `end` from each state."""
    cost = [_FAR] * 4
    cost[end] = 0
    for i in reversed(range(low, high)):
        price = items[i][0]
        cost = [min(min(p[t] + cost[t] for t in range(4)), _FAR) for p in price]
    return cost


def final(items: Sequence[Item]) -> tuple[int, int]:
    """Least cost, and the state after the last item on the least way."""
    cost, rank = _ahead(items, 0, len(items), 0)
    total, _, state = min((cost[x] + _CLOSING[x][0], rank[x], x) for x in range(4))
    return total, state


def states(items: Sequence[Item], start: int, end: int) -> list[int]:
    """The states between the items on the least cheapest way, by divide and conquer.

    Forward and backward cost vectors meet in the middle; of the optimal crossings the
    one whose way there is least in letters is taken, then both halves are done alike.
    """
    out = [start] + [end] * len(items)
    todo = [(0, len(items))]
    while todo:
        low, high = todo.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        cost, rank = _ahead(items, low, middle, out[low])
        rest = _behind(items, middle, high, out[high])
        out[middle] = min(range(4), key=lambda x: (cost[x] + rest[x], rank[x]))
        todo += [(low, middle), (middle, high)]
    return out


@lru_cache(maxsize=1 << 14)
def _audit(codes: bytes, start: int, end: int) -> str:
    """Letters of the edits over rows with these codes."""
    items = [_ROWS[code] for code in codes]
    way = states(items, start, end)
    return "".join(item[1][a][b] for item, a, b in zip(items, way, way[1:]))


@lru_cache(maxsize=1 << 14)
def _solved(codes: bytes) -> tuple[int, str]:
    """Least cost and edits of a whole conversation."""
    cost, state = final([_ROWS[code] for code in codes])
    return cost, _audit(codes, 0, state) + _CLOSING[state][1]


def lines(audit: str, state: int, roles: Sequence[str], texts: Sequence[str]) -> list[str]:
    """`role:text` of each row that the edits leave or add, from this state on."""
    out, row = [], 0
    for letter in audit:
        if letter == "K":
            state = _INITIAL[roles[row][0]]
            out.append(f"{roles[row]}:{texts[row]}")
        elif letter in "IR":
            state = _next(state, letter, 0)
            text = texts[row] if letter == "R" else ""
            out.append(f"{'user' if state == _USER else 'assistant'}:{text}")
        row += letter != "I"
    return out


def codes(roles: Sequence[str], texts: Sequence[str], first: Sequence[bool] | None = None):
    """Codes of the rows, and the numbers of blank, duplicate and truncated ones.

    `first` tells which rows have not been seen earlier; without it these rows are the
    whole conversation.
    """
    seen: set[tuple[str, str]] = set()
    out, counts = bytearray(), [0, 0, 0]
    for i, (role, text) in enumerate(zip(roles, texts)):
        code, seen_text = _INITIAL.get(role[:1], 0), text.rstrip(SPACE)
        if first is None:
            new = (role, text) not in seen
            seen.add((role, text))
        else:
            new = first[i]
        if not seen_text:
            code, counts[0] = code | _GONE, counts[0] + 1
        elif not new:
            code, counts[1] = code | _GONE, counts[1] + 1
        elif seen_text[-1] not in ".!?":
            code, counts[2] = code | _OPEN, counts[2] + 1
        out.append(code)
    return bytes(out), counts


def _illegal(initials: Sequence[int]) -> int:
    return sum(pair not in _LEGAL for pair in zip(initials, initials[1:]))


def _gaps(turns: Sequence[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after the stated damage, by crc32(`conv_id:turn`) % 20.

    0 drops the row (it stays as `dropped`, so that its conversation is not lost), 1
    empties its text, 2 takes `.`, `!`, `?` out of it, 3 gives it twice, 4 makes it the
    user's. Missing values count as one space, but a missing turn stays missing.
    """
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    return rows.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(shown("role")).alias("role"),
        text.alias("text"),
        (kind == 0).alias("dropped"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def pieces(rows: DataFrame) -> DataFrame:
    """Consecutive rows of one conversation, as arrays; written once.

    Rows are ordered by conversation, turn (missing first), role and a hash of the text
    over all tasks, so a conversation of any length is spread over many of them. Within
    a task it is cut at 65,536 rows or 16 MB. `whole` marks conversations of one piece
    that lie between two others of their task and so cannot go on elsewhere.
    """
    key = rows.schema["conv_id"]
    schema = StructType(
        [
            StructField("conv_id", key.dataType),
            StructField("part", IntegerType()),
            StructField("no", LongType()),
            StructField("whole", BooleanType()),
            StructField("turns", ArrayType(LongType())),
            StructField("roles", ArrayType(StringType())),
            StructField("texts", ArrayType(StringType())),
        ]
    )
    arrow = [pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]):
        part, number, first = TaskContext.get().partitionId(), 0, True
        conversation, held, size, cut = None, [], 0, False
        done: list[tuple] = []

        def piece(whole: bool):
            nonlocal number, held, size
            turns, roles, texts = (list(c) for c in zip(*held)) if held else ([], [], [])
            done.append((conversation, part, number, whole, turns, roles, texts))
            number, held, size = number + 1, [], 0

        def handed_on():
            columns = list(zip(*done))
            done.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], key_type), *(pa.array(c, t) for c, t in zip(columns[1:], arrow))],
                schema.fieldNames(),
            )

        started, key_type, bulk = False, None, 0
        for batch in batches:
            key_type = batch.schema.field("conv_id").type
            for name, turn, role, text, dropped in zip(*(c.to_pylist() for c in batch.columns)):
                if started and name != conversation:
                    piece(whole=not first and not cut)
                    first = cut = False
                    if bulk > PIECE_BYTES or len(done) >= 4096:
                        yield handed_on()
                        bulk = 0
                conversation, started = name, True
                if not dropped:
                    held.append((turn, role, text))
                    size += len(text)
                    bulk += len(text)
                    if len(held) >= PIECE_ROWS or size >= PIECE_BYTES:
                        piece(whole=False)
                        cut = True
        if started:
            piece(whole=False)
        if done:
            yield handed_on()

    row = F.monotonically_increasing_id().alias("row")
    ordered = (
        rows.select("conv_id", "turn", "role", "text", "dropped", F.md5("text").alias("digest"), row)
        .repartitionByRange(tables.parallelism(rows), "conv_id", "turn", "role", "digest", "row")
        .sortWithinPartitions("conv_id", "turn", "role", "digest")
        .select("conv_id", "turn", "role", "text", "dropped")
    )
    return tables.settled(ordered.mapInArrow(run, schema), "conversation-pieces")


_FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _result_schema(pieces: DataFrame) -> StructType:
    return StructType(
        [
            *(pieces.schema[name] for name in ("conv_id", "part", "no")),
            *(StructField(name, LongType()) for name in _FIGURES),
            StructField("audit", StringType()),
            StructField("repaired", StringType()),
            StructField("whole", BooleanType()),
        ]
    )


def _batch(rows: list[tuple], schema: StructType, key_type: pa.DataType) -> pa.RecordBatch:
    kinds = {
        IntegerType(): pa.int32(),
        LongType(): pa.int64(),
        StringType(): pa.string(),
        BinaryType(): pa.binary(),
        BooleanType(): pa.bool_(),
    }
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(values, key_type if field.name == "conv_id" else kinds[field.dataType])
            for values, field in zip(columns, schema)
        ],
        schema.fieldNames(),
    )


def _whole(pieces: DataFrame) -> DataFrame:
    """Repair of conversations that are one piece."""
    schema = _result_schema(pieces)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for name, part, no, turns, roles, texts in zip(*(c.to_pylist() for c in batch.columns)):
                coded, counts = codes(roles, texts)
                cost, audit = _solved(coded) if len(coded) < 64 else _solved.__wrapped__(coded)
                figures = (_gaps(turns), *counts, _illegal([c & 3 for c in coded]), cost)
                out.append((name, part, no, *figures, audit, "\n".join(lines(audit, 0, roles, texts)), True))
            yield _batch(out, schema, batch.schema.field("conv_id").type)

    narrow = pieces.where("whole").select("conv_id", "part", "no", "turns", "roles", "texts")
    return narrow.mapInArrow(run, schema)


def _first_rows(pieces: DataFrame) -> DataFrame:
    """Per piece the places of the rows that occur nowhere earlier in the conversation."""
    key = pieces.schema["conv_id"]
    schema = StructType(
        [key, StructField("part", IntegerType()), StructField("no", LongType()),
         StructField("place", IntegerType()), StructField("digest", BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name, part, no, roles, texts in zip(*(c.to_pylist() for c in batch.columns)):
                seen: dict[bytes, int] = {}
                for i, (role, text) in enumerate(zip(roles, texts)):
                    seen.setdefault(hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), i)
                out = [(name, part, no, i, digest) for digest, i in seen.items()]
                yield _batch(out, schema, batch.schema.field("conv_id").type)

    return (
        pieces.select("conv_id", "part", "no", "roles", "texts")
        .mapInArrow(run, schema)
        .groupBy("conv_id", "digest")
        .agg(F.min(F.struct("part", "no", "place")).alias("at"))
        .groupBy("conv_id", "at.part", "at.no")
        .agg(F.collect_list("at.place").alias("firsts"))
    )


def _alike(left: DataFrame, right: DataFrame) -> Column:
    return left["conv_id"].eqNullSafe(right["conv_id"]) & (left["part"] == right["part"]) & (left["no"] == right["no"])


def _coded(pieces: DataFrame, firsts: DataFrame) -> DataFrame:
    """Per piece its codes, figures and texts, and cost and order between all states."""
    key = pieces.schema["conv_id"]
    longs = ["blank", "duplicate", "truncated", "illegal", "distinct", "low", "high"]
    schema = StructType(
        [
            key,
            StructField("part", IntegerType()),
            StructField("no", LongType()),
            *(StructField(name, LongType()) for name in longs),
            StructField("codes", BinaryType()),
            StructField("ways", BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name, part, no, turns, roles, texts, firsts in zip(*(c.to_pylist() for c in batch.columns)):
                first = [False] * len(roles)
                for i in firsts or ():
                    first[i] = True
                coded, counts = codes(roles, texts, first)
                known = {t for t in turns if t is not None}
                items = [_ROWS[code] for code in coded]
                ways = [_ahead(items, 0, len(items), start) for start in range(4)]
                figures = (*counts, _illegal([c & 3 for c in coded]), len(known), min(known, default=None), max(known, default=None))
                out = (name, part, no, *figures, coded, np.array(ways, np.int64).tobytes())
                yield _batch([out], schema, batch.schema.field("conv_id").type)

    joined = pieces.join(firsts, _alike(pieces, firsts), "left").select(
        pieces["conv_id"], pieces["part"], pieces["no"], "turns", "roles", "texts", "firsts"
    )
    return joined.mapInArrow(run, schema)


def _placed(coded: DataFrame) -> DataFrame:
    """Per piece the states at its ends, and on the first piece the figures of all.

    A conversation's pieces meet as matrices of four by four, one small row per piece.
    """
    key = coded.schema["conv_id"]
    schema = StructType(
        [key, StructField("part", IntegerType()), StructField("no", LongType()),
         StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("last", IntegerType()),
         *(StructField(name, LongType()) for name in _FIGURES)]
    )

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["no"]))
        items = []
        for row in rows:
            ways = np.frombuffer(row["ways"], np.int64).reshape(4, 2, 4).tolist()
            items.append(([w[0] for w in ways], [w[1] for w in ways]))
        cost, state = final(items)
        way = states(items, 0, state)
        known = [r for r in rows if r["distinct"]]
        distinct = sum(r["distinct"] for r in known)
        distinct -= sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
        full = [r for r in rows if r["size"]]
        seams = [(a["tail"] & 3, b["head"] & 3) for a, b in zip(full, full[1:])]
        figures = [
            known[-1]["high"] - known[0]["low"] + 1 - distinct if known else 0,
            *(sum(r[name] for r in rows) for name in ("blank", "duplicate", "truncated")),
            sum(r["illegal"] for r in rows) + sum(pair not in _LEGAL for pair in seams),
            cost,
        ]
        out = [
            (r["conv_id"], r["part"], r["no"], a, b, int(i == len(rows) - 1), *(figures if i == 0 else [None] * 6))
            for i, (r, a, b) in enumerate(zip(rows, way, way[1:]))
        ]
        return pa.Table.from_batches([_batch(out, schema, group.schema.field("conv_id").type)])

    small = coded.withColumn("size", F.octet_length("codes"))
    at = lambda place: F.conv(F.hex(F.substring("codes", place, F.lit(1))), 16, 10).cast("int")
    small = small.withColumn("head", at(F.lit(1))).withColumn("tail", at(F.greatest("size", F.lit(1)))).drop("codes")
    return small.groupBy("conv_id").applyInArrow(run, schema)


def _parts(pieces: DataFrame) -> DataFrame:
    """Repair of conversations that may lie in several pieces."""
    split = pieces.where("NOT whole")
    coded = tables.settled(_coded(split, _first_rows(split)), "conversation-codes")
    placed = _placed(coded)
    both = coded.select("conv_id", "part", "no", "codes").join(placed, _alike(coded, placed)).select(
        coded["conv_id"], coded["part"], coded["no"], "codes", "start", "end", "last", *_FIGURES
    )
    joined = split.join(both, _alike(split, both)).select(
        split["conv_id"], split["part"], split["no"], "roles", "texts", "codes", "start", "end", "last", *_FIGURES
    )
    schema = _result_schema(pieces)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name, part, no, roles, texts, coded, start, end, last, *figures in zip(
                *(c.to_pylist() for c in batch.columns)
            ):
                audit = _audit.__wrapped__(coded, start, end) + (_CLOSING[end][1] if last else "")
                out = (name, part, no, *figures, audit, "\n".join(lines(audit, start, roles, texts)), False)
                yield _batch([out], schema, batch.schema.field("conv_id").type)

    return joined.mapInArrow(run, schema)


def repair(rows: DataFrame) -> DataFrame:
    """The cheapest repair of every conversation of conv_id, turn, role, text, dropped.

    One row per piece of a conversation, in the order of (part, no): its edits and its
    repaired rows as `role:text` lines. `whole` marks a conversation known to be one
    piece; the first piece has the conversation's gaps
    (turns missing between the least and the greatest), blank, duplicate and truncated
    rows (each row counts once), illegal neighbours and cost. Most conversations are one
    piece. Rows are taken by turn, missing ones first, equal ones by role and a hash of
    the text. An empty role has no initial and cannot be kept, nor can one that starts
    with another letter than s, u, a. A conversation whose rows are all dropped, and
    only that, has no lines and figures of zero; a missing conv_id is a conversation of
    its own; an empty table gives an empty one; other columns are not read.
    """
    cut = pieces(rows)
    return _whole(cut).union(_parts(cut))


def summary(repaired: DataFrame) -> DataFrame:
    """One row per conversation: figures, all edits and the digest of the repaired rows.

    Pieces of a long conversation follow one another through one task, which holds the
    letters of its edits but only one piece of its text at a time.
    """
    key = repaired.schema["conv_id"]
    schema = StructType(
        [key, *(StructField(n, LongType()) for n in _FIGURES),
         StructField("audit", StringType()), StructField("repaired_sha256", StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]):
        held, audit, digest, key_type = None, [], None, None

        def row():
            return (held[0], *held[1], "".join(audit), digest.hexdigest())

        for batch in batches:
            key_type, out = batch.schema.field("conv_id").type, []
            for name, part, no, *figures, edits, text, _ in zip(*(c.to_pylist() for c in batch.columns)):
                if figures[0] is not None:
                    if held is not None:
                        out.append(row())
                    held, audit, digest, any_line = (name, figures), [], hashlib.sha256(), False
                audit.append(edits)
                if edits.strip("D"):
                    digest.update((("\n" if any_line else "") + text).encode())
                    any_line = True
            yield _batch(out, schema, key_type)
        if held is not None:
            yield _batch([row()], schema, key_type)

    alone = repaired.where("whole").select(
        "conv_id", *_FIGURES, "audit", F.sha2("repaired", 256).alias("repaired_sha256")
    )
    joined = (
        repaired.where("NOT whole")
        .repartition(tables.parallelism(repaired), "conv_id")
        .sortWithinPartitions("conv_id", "part", "no")
        .mapInArrow(run, schema)
    )
    return alone.union(joined)
