"""Repair of conversations at the least cost: a run-length dynamic program over role and fault symbols.

A conversation is sound if its roles' initials are ``(s?(ua)+)?``. A turn may be kept, get another role (user or assistant),
or be deleted, and empty turns may be inserted. Turns without a word and turns whose role and text were seen earlier must go, turns that
stop without a full stop cost more if they stay. Of the cheapest lists of edits the ASCII-least is taken.

Each turn is one of ten symbols; equal consecutive ones are a run. A symbol's transition is a min-plus matrix over the four states of the
pattern, with inserts before the turn; a run takes the product of its cached binary powers. Matrices are products, so a long
conversation is cut into pieces of at most ``PIECE_ROWS`` rows that are multiplied apart: (1) each piece's matrix; (2) from
a conversation's end, the cost that is still to come after each piece, from one matrix a piece; (3) for each piece and state that it may begin in, the edits,
by halving runs down to single turns, choices kept by symbol, size, state and costs to come; (4) from the beginning, the
state that each piece does begin in. No step holds a conversation: the second and fourth read a hundred bytes a piece in one task, in order.

Turns are laid out by ranges of (conversation, turn), so that a conversation may lie on many tasks. Equal turns are added up
before they are shuffled, and of turns with one role and text only the first carries its text on.

Defined results: a null role or text is one space; turns go by number, nulls first, then by role, then by their text's SHA-256; a null conversation is one too;
texts and conversations may be of any length; repeated rows are turns of their own; an empty table gives no rows; only the four columns
named are read, others may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import materialize

#: Rows of a piece, as a power of two; results that a worker remembers.
PIECE_BITS = 12
PIECE_ROWS = 1 << PIECE_BITS
REMEMBERED = 200_000
#: Costs of edits, and what a turn that stops short adds if it stays.
REROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
#: White space, and what ends a sentence.
SPACES, STOPS = " \t\n\x0b\x0c\r", ".!?"
#: States of the pattern: nothing yet, after s, after u, after a. What a letter leads to from each (None: it can't stand there).
STATES = range(4)
LETTERS = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
ENDS = (0, 3)
OUT_OF_REACH = 1 << 50
#: Symbols: 0 must be deleted; 1 + 2 * initial + cut, the initials being s, u, a and any other.
GONE, N_SYMBOLS = 0, 9

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def _remember(function: Callable) -> Callable:
    """The results of a function of hashable arguments, dropped when there are too many."""
    known: dict = {}

    def remembered(*args):
        if (found := known.get(args)) is None:
            if len(known) >= REMEMBERED:
                known.clear()
            found = known[args] = function(*args)
        return found

    return remembered


def _next(state: int) -> tuple[str, int]:
    """The role that an inserted or changed turn gets after a state, and the state that it leads to."""
    return ("assistant", 3) if state == 2 else ("user", 2)


def _choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """What may be done with a turn: (edit, cost, state after it), in the edits' order."""
    found = [("D", DELETE, state)]
    if symbol != GONE:
        initial, cut = "sua?"[(symbol - 1) // 2], (symbol - 1) % 2
        if initial in LETTERS and (to := LETTERS[initial][state]) is not None:
            found.append(("K", cut * CUT_SHORT, to))
        found.append(("R", REROLE + cut * CUT_SHORT, _next(state)[1]))
    return found


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(OUT_OF_REACH, min(x + b[k][j] for k, x in enumerate(row))) for j in STATES) for row in a)


def _scaled(matrix: Matrix) -> tuple[int, Matrix]:
    """The smallest entry, and the matrix less it."""
    least = min(map(min, matrix))
    return least, tuple(tuple(x if x >= OUT_OF_REACH else x - least for x in row) for row in matrix)


def _inserts() -> Matrix:
    """Cost of getting from a state to another by inserts alone."""
    rows = []
    for state in STATES:
        cost, row = 0, [OUT_OF_REACH] * 4
        while row[state] == OUT_OF_REACH:
            row[state], cost, state = cost, cost + INSERT, _next(state)[1]
        rows.append(tuple(row))
    return tuple(rows)


INSERTS = _inserts()
#: What is still to come at a conversation's end.
AT_END: Vector = tuple(min(row[e] for e in ENDS) for row in INSERTS)


@_remember
def _power(symbol: int, k: int) -> Matrix:
    """The transition of 2**k turns of a symbol, inserts before each included."""
    if k:
        half = _power(symbol, k - 1)
        return _times(half, half)
    edits = [[OUT_OF_REACH] * 4 for _ in STATES]
    for state in STATES:
        for _, cost, to in _choices(symbol, state):
            edits[state][to] = min(edits[state][to], cost)
    return _times(INSERTS, tuple(map(tuple, edits)))


def _sizes(length: int) -> list[int]:
    """The powers of two that make up a length, the largest first."""
    return [k for k in reversed(range(length.bit_length())) if length >> k & 1]


@_remember
def _advanced(matrix: Matrix, symbol: int, length: int) -> tuple[int, Matrix]:
    for k in _sizes(length):
        matrix = _times(matrix, _power(symbol, k))
    return _scaled(matrix)


@_remember
def _before(matrix: Matrix, to_come: Vector) -> tuple[int, Vector]:
    """Costs to come before a piece from those after it, less the smallest, which comes first."""
    found = [min(x + y for x, y in zip(row, to_come)) for row in matrix]
    return min(found), tuple(x - min(found) for x in found)


def _before_run(symbol: int, k: int, to_come: Vector) -> Vector:
    return _before(_power(symbol, k), to_come)[1]


@_remember
def _unrolled(symbol: int, k: int, state: int, to_come: Vector) -> tuple[str, int]:
    """The least of the cheapest edits of 2**k turns of a symbol from a state, and the state after them."""
    if symbol == GONE:
        return "D" * (1 << k), state
    if k:
        first, middle = _unrolled(symbol, k - 1, state, _before_run(symbol, k - 1, to_come))
        second, end = _unrolled(symbol, k - 1, middle, to_come)
        return first + second, end
    done = [min(cost + to_come[to] for _, cost, to in _choices(symbol, q)) for q in STATES]
    best = [min(x + y for x, y in zip(row, done)) for row in INSERTS]
    edits = ""
    while True:
        inserted = _next(state)[1]
        choices = [(edit, cost + to_come[to], to) for edit, cost, to in _choices(symbol, state)] + [("I", INSERT + best[inserted], inserted)]
        edit, _, state = min(c for c in choices if c[1] == best[state])
        edits += edit
        if edit != "I":
            return edits, state


def _run_edits(symbol: int, length: int, state: int, to_come: Vector) -> tuple[str, int]:
    if symbol == GONE:
        return "D" * length, state
    after = [to_come]
    sizes = _sizes(length)
    for k in reversed(sizes[1:]):
        after.append(_before_run(symbol, k, after[-1]))
    edits = []
    for k in sizes:
        part, state = _unrolled(symbol, k, state, after.pop())
        edits.append(part)
    return "".join(edits), state


def piece_edits(runs: list[tuple[int, int]], state: int, to_come: Vector, last: bool) -> tuple[str, int]:
    """runs: (symbol, length). The edits from a state, given the costs to come, and the state after them; with a conversation's closing inserts."""
    after = [to_come]
    for symbol, length in reversed(runs[1:]):
        for k in _sizes(length):
            to_come = _before_run(symbol, k, to_come)
        after.append(to_come)
    edits = []
    for symbol, length in runs:
        part, state = _run_edits(symbol, length, state, after.pop())
        edits.append(part)
    while last and AT_END[state]:
        edits.append("I")
        state = _next(state)[1]
    return "".join(edits), state


def runs_matrix(runs: list[tuple[int, int]]) -> tuple[int, Matrix]:
    cost, matrix = _scaled(tuple(tuple(0 if i == j else OUT_OF_REACH for j in STATES) for i in STATES))
    for symbol, length in runs:
        more, matrix = _advanced(matrix, symbol, length)
        cost += more
    return cost, matrix


# -- the turns in order ------------------------------------------------------------------------------------------------------


def _kind(text: Column) -> Column:
    """0 whole, 1 stops short, 2 blank."""
    end = F.rtrim(text, F.lit(SPACES))
    return F.when(end == "", 2).when(F.right(end, F.lit(1)).isin(*STOPS), 0).otherwise(1)


def _laid(turns: DataFrame) -> DataFrame:
    """Equal turns as one row, in order: conv_id, turn, role, text (of the first with its role and text, else null), n, kind, at (ascending)."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    counted = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), _kind(F.col("text")).alias("kind")).groupBy("conv_id", "turn", "role", "digest", "kind").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("conv_id", "role", "text").agg(F.when(F.min(F.col("turn").isNotNull()), F.min("turn")).alias("turn"))
    first = first.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), _kind(F.col("text")).alias("kind"), F.lit(0).cast("long").alias("n"), "text")
    keys = ["conv_id", "turn", "role", "digest"]
    both = counted.withColumn("text", F.lit(None).cast("string")).unionByName(first).repartitionByRange(*keys)
    merged = both.groupBy(*keys).agg(F.max("kind").alias("kind"), F.sum("n").alias("n"), F.max("text").alias("text"))
    return materialize(merged.sortWithinPartitions(*keys).drop("digest").withColumn("at", F.monotonically_increasing_id()), "turns")


def _initial(role: Column) -> Column:
    return F.coalesce(*(F.when(F.substring(role, 1, 1) == x, i) for i, x in enumerate("sua")), F.lit(3))


class _Piece(NamedTuple):
    cost: int
    matrix: list[int]
    symbols: bytes
    lengths: bytes


_PIECE = "at long, cost long, matrix array<bigint>, symbols binary, lengths binary, head int, tail int, illegal long, low long, high long, turns long, blank long, duplicate long, truncated long"


def _held(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows that follow each other with equal keys (pieces: at most ``PIECE_ROWS`` rows), and where each group begins."""
    held = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
        begins = _begins(held, keys)
        if len(begins) > 1:
            yield held.slice(0, begins[-1]).combine_chunks(), begins[:-1]
            held = held.slice(begins[-1]).combine_chunks()
    if held is not None and held.num_rows:
        yield held, _begins(held, keys)


def _begins(rows: pa.Table, keys: list[str]) -> np.ndarray:
    changes = np.zeros(rows.num_rows, bool)
    changes[:1] = True
    for key in keys:
        codes = rows[key].combine_chunks().dictionary_encode(null_encoding="encode")
        codes = (codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
        changes[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(changes)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation's rows in a piece of the order: its runs, their matrix, and what the report counts."""
    for rows, begins in _held(batches, ["conv_id", "piece"]):
        at, n, kind, initial, first = (rows[c].to_numpy() for c in ("at", "n", "kind", "initial", "first"))
        turn, known = pc.fill_null(rows["turn"], 0).to_numpy(), rows["turn"].is_valid().to_numpy()
        piece = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(at))))
        stays = first & (kind < 2)
        # each row is at most two runs: its first turn, and the rest
        symbols = np.column_stack([np.where(stays, 1 + 2 * initial + (kind == 1), GONE), np.full(len(at), GONE)]).ravel()
        lengths = np.column_stack([stays, n - stays]).ravel()
        of = np.repeat(piece, 2)
        some = lengths > 0
        symbols, lengths, of = symbols[some], lengths[some], of[some]
        edge = np.append(True, (symbols[1:] != symbols[:-1]) | (of[1:] != of[:-1]))
        starts = np.flatnonzero(edge)
        lengths = np.add.reduceat(lengths, starts)
        symbols, of = symbols[starts], of[starts]
        bounds = np.searchsorted(of, np.arange(len(begins) + 1))
        total = lambda x: np.add.reduceat(x.astype(np.int64), begins)
        inside = np.append(False, piece[1:] == piece[:-1])
        sound = np.append(False, _alternate(initial[:-1], initial[1:]))
        new_turn = known & ~(inside & np.append(False, known[:-1] & (turn[1:] == turn[:-1])))
        made = [_made(symbols[a:b], lengths[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        ends = np.append(begins[1:], len(at)) - 1
        some_turn = np.maximum.reduceat(known, begins)
        high = [int(x) if y else None for x, y in zip(np.where(known, turn, np.iinfo(np.int64).min)[ends], some_turn)]
        low = [int(x) if y else None for x, y in zip(np.minimum.reduceat(np.where(known, turn, np.iinfo(np.int64).max), begins), some_turn)]
        yield pa.RecordBatch.from_pydict(
            {
                "conv_id": rows["conv_id"].combine_chunks().take(pa.array(begins)),
                "at": pa.array(at[begins], pa.int64()),
                "cost": pa.array([m.cost for m in made], pa.int64()),
                "matrix": pa.array([m.matrix for m in made], pa.list_(pa.int64())),
                "symbols": pa.array([m.symbols for m in made], pa.binary()),
                "lengths": pa.array([m.lengths for m in made], pa.binary()),
                "head": pa.array(initial[begins], pa.int32()),
                "tail": pa.array(initial[ends], pa.int32()),
                "illegal": pa.array(total(n - 1) + total(inside & ~sound), pa.int64()),
                "low": pa.array(low, pa.int64()),
                "high": pa.array(high, pa.int64()),
                "turns": pa.array(total(new_turn), pa.int64()),
                "blank": pa.array(total(np.where(kind == 2, n, 0)), pa.int64()),
                "duplicate": pa.array(total(np.where(kind == 2, 0, n - stays)), pa.int64()),
                "truncated": pa.array(total(stays & (kind == 1)), pa.int64()),
            }
        )


def _alternate(before, after):
    """Whether a role's initial may follow another: su, ua, au."""
    return ((before == 0) & (after == 1)) | ((before == 1) & (after == 2)) | ((before == 2) & (after == 1))


def _made(symbols: np.ndarray, lengths: np.ndarray) -> _Piece:
    cost, matrix = runs_matrix(list(zip(symbols.tolist(), lengths.tolist())))
    return _Piece(cost, [x for row in matrix for x in row], symbols.astype(np.uint8).tobytes(), lengths.astype(np.int64).tobytes())


_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_BACKWARD = "at long, first boolean, last boolean, to_come array<bigint>, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces by conversation, the last first: the costs to come after each; after a conversation's first piece its report."""
    now, later, held = _NONE, {}, None

    def closed() -> list[dict]:
        """The conversation's first piece, and its report."""
        if held is None:
            return []
        gaps = later["high"] - later["low"] + 1 - later["turns"] if later["low"] is not None else 0
        return [held | {"first": True}, {"conv_id": now, "gaps": gaps, "cost": later["cost"] + later["to_come"][0]} | {c: int(later[c]) for c in _REPORT[1:5]}]

    for batch in batches:
        field, out = batch.schema.field("conv_id"), []
        for x in batch.to_pylist():
            is_last = now is _NONE or x["conv_id"] != now
            if is_last:
                out += closed()
                now, later = x["conv_id"], {"to_come": AT_END, "cost": 0, "low": None, "high": x["high"], "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
            else:
                out.append(held)
                later["illegal"] += not _alternate(x["tail"], later["head"])
                later["turns"] -= x["high"] is not None and x["high"] == later["low"]
            held = {"conv_id": now, "at": x["at"], "first": False, "last": is_last, "to_come": later["to_come"]}
            least, before = _before(tuple(tuple(x["matrix"][i : i + 4]) for i in (0, 4, 8, 12)), tuple(later["to_come"]))
            for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                later[c] += x[c]
            later |= {"to_come": before, "cost": later["cost"] + x["cost"] + least, "head": x["head"], "low": later["low"] if x["low"] is None else x["low"]}
        if out:
            yield pa.RecordBatch.from_pylist(out, _schema(field, _BACKWARD))
    if held is not None:
        yield pa.RecordBatch.from_pylist(closed(), _schema(field, _BACKWARD))


_NONE = object()


def _schema(conv_id: pa.Field, ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([conv_id, *(pa.field(name, kinds[kind]) for name, kind in (x.split(" ") for x in ddl.split(", ")))])


_AUDITS = "at long, ends array<bigint>, audits array<string>"


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each piece for every state that it may begin in; a conversation's first piece begins in state 0."""
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            runs = list(zip(x["symbols"], np.frombuffer(x["lengths"], np.int64).tolist()))
            made = [piece_edits(runs, state, tuple(x["to_come"]), x["last"]) for state in (STATES[:1] if x["first"] else STATES)]
            out.append({"conv_id": x["conv_id"], "at": x["at"], "ends": [end for _, end in made], "audits": [edits for edits, _ in made]})
        yield pa.RecordBatch.from_pylist(out, _schema(batch.schema.field("conv_id"), _AUDITS))


def _begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces by conversation in order: the state that each begins in."""
    now, state = _NONE, 0
    for batch in batches:
        begins = []
        for conv_id, ends in zip(batch.column("conv_id").to_pylist(), batch.column("ends").to_pylist()):
            if now is _NONE or conv_id != now:
                now, state = conv_id, 0
            begins.append(state)
            state = ends[state]
        yield pa.RecordBatch.from_arrays([batch.column("at"), pa.array(begins, pa.int32())], ["at", "state"])


_EDITS = "at long, step int, edit string, times long, role string, text string"


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each piece's edits (side 0) before its turns: what becomes of each turn."""
    edits, here, state, where = "", 0, 0, None

    def inserted(step: int) -> Iterator[dict]:
        nonlocal here, state
        while edits[here : here + 1] == "I":
            role, state = _next(state)
            yield {"conv_id": where[0], "at": where[1], "step": step, "edit": "I", "times": 1, "role": role, "text": ""}
            here, step = here + 1, step + 1

    for batch in batches:
        out: list[dict] = []
        for x in batch.to_pylist():
            if x["side"] == 0:
                out += inserted(100) if where else ()
                edits, here, state = x["audit"], 0, x["state"]
                continue
            where = x["conv_id"], x["at"]
            named = {"conv_id": x["conv_id"], "at": x["at"]}
            stays = x["text"] is not None and x["kind"] < 2
            if stays:
                out += inserted(0)
                edit, here = edits[here], here + 1
                role, text = (None, None) if edit == "D" else (x["role"], x["text"]) if edit == "K" else (_next(state)[0], x["text"])
                if edit != "D":
                    state = LETTERS[role[0]][state]
                out.append(named | {"step": 50, "edit": edit, "times": 1, "role": role, "text": text})
            if x["n"] > stays:
                here += x["n"] - stays
                out.append(named | {"step": 60, "edit": "D", "times": x["n"] - stays, "role": None, "text": None})
        yield pa.RecordBatch.from_pylist(out, _schema(batch.schema.field("conv_id"), _EDITS))
    if where:
        yield pa.RecordBatch.from_pylist(list(inserted(100)), _schema(batch.schema.field("conv_id"), _EDITS))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns: conv_id, turn, role, text.

    Reports, a row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost. Edits, in the order (at, step) within a
    conversation: conv_id, at, step, edit (K, R, D or I), times, role and text after it (null if deleted). Consecutive deletions may be one row.
    """
    conv = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, "
    laid = _laid(turns)
    piece = F.shiftright("at", PIECE_BITS).alias("piece")
    narrow = laid.select("conv_id", "at", piece, "turn", _initial(F.col("role")).alias("initial"), "kind", F.col("text").isNotNull().alias("first"), "n")
    pieces = materialize(narrow.repartition("piece").sortWithinPartitions("at").mapInArrow(_pieces, conv + _PIECE), "pieces")
    backward = materialize(pieces.drop("symbols", "lengths").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("at")).mapInArrow(_backward, conv + _BACKWARD), "backward")
    costs = backward.filter("at is not null").select("at", "first", "last", "to_come")
    audits = materialize(pieces.select("conv_id", "at", "symbols", "lengths").join(costs, "at").mapInArrow(_audited, conv + _AUDITS), "audits")
    begun = audits.select("conv_id", "at", "ends").repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_begun, "at long, state int")
    chosen = audits.join(begun, "at").select("conv_id", "at", piece, F.lit(0).alias("side"), F.get("audits", F.col("state")).alias("audit"), "state")
    rows = laid.select("conv_id", "at", piece, F.lit(1).alias("side"), "role", "text", "n", "kind")
    lined = chosen.unionByName(rows, allowMissingColumns=True).repartition("piece").sortWithinPartitions("at", "side")
    edits = lined.mapInArrow(_applied, conv + _EDITS)
    return backward.filter("at is null").select("conv_id", *_REPORT), edits
