"""Conversation structure repair by layers of cost.

A conversation is right if its roles read ``(s?(ua)+)?``. Four grammar states tell how far a
prefix has come. For each cost, from 0 up, a layer holds for every turn the bitset of states
from which the rest can be repaired at that cost: keeping passes a layer's own next bitset on,
deleting, reroling and inserting those of cheaper layers. The first layer that holds the
start's state gives the cost; a trace through the bits, which tries edits in the order of their
letters, gives the least audit. Layers of many conversations are computed side by side.

Rows are dealt by ranges of (conversation, turn, role, text), so that no conversation has to
be in one task, and become blocks of at most ``BLOCK`` turns. Nearly all conversations are one
block. For longer ones, and the two at a partition's ends, layers give each block's costs from
each state to each; they are joined within a partition first, then over partitions, of which
there are few. So every block learns the costs after it and the state before it, and is traced
alone. The hash of a repaired conversation runs over its blocks in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.llm.common import stored

#: Turns of a block that may stay, and about the bytes of its texts.
BLOCK, BLOCK_BYTES = 64, 1 << 20
#: Cost of an insertion or a new role, of a deletion, and of a truncated turn that stays.
CHANGE, DELETE, CUT = 2, 3, 1
#: Cells of bitsets that are computed together.
CELLS = 1 << 23

# States: 0 nothing yet, 1 after a system turn, 2 after a user turn, 3 after an assistant turn.
NEXT = np.array([2, 2, 3, 2])  # by an inserted or renamed turn
NAMES = ["user", "user", "assistant", "user"]
INITIALS = "sua"
#: State after keeping a turn with initial s, u, a or another; 4: not allowed.
KEPT = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
#: What ending costs in each state, by insertions.
ENDING = np.array([0, 4, 2, 0])


def _before(after: np.ndarray) -> np.ndarray:
    """For each bitset the states that a step (``after`` each state) leads into it."""
    return np.array([sum(1 << s for s in range(4) if after[s] < 4 and bits >> after[s] & 1) for bits in range(16)], np.uint8)


BEFORE_KEPT, BEFORE_ANY = np.array([_before(row) for row in KEPT]), _before(NEXT)


def layers(codes: np.ndarray, lengths: np.ndarray, ends: np.ndarray, wanted: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(bitsets by cost, instance and turn; cost at which an instance has all ``wanted`` states, -1 if above ``most``).

    ``codes``: right-aligned turns of each instance, initial (0 to 3) plus 4 if truncated; ``ends``: cost after the last turn in each state.
    """
    n, width = codes.shape
    role, cut = codes & 3, codes > 3
    none = np.zeros((n, width + 1), np.uint8)
    made: list[np.ndarray] = []
    found, first = np.full(n, -1), width - lengths
    back = lambda k: made[k] if k >= 0 else none
    for k in range(most + 1):
        now = np.zeros((n, width + 1), np.uint8)
        now[:, width] = ((ends <= k) << np.arange(4)).sum(axis=1)
        made.append(now)
        deleted, changed, inserted, kept_cut = back(k - DELETE), np.where(cut, back(k - CHANGE - CUT)[:, 1:], back(k - CHANGE)[:, 1:]), back(k - CHANGE), back(k - CUT)
        ready = deleted[:, 1:] | BEFORE_ANY[changed] | BEFORE_ANY[inserted[:, :-1]] | np.where(cut, BEFORE_KEPT[role, kept_cut[:, 1:]], 0)
        for j in range(width - 1, -1, -1):
            now[:, j] = ready[:, j] | np.where(cut[:, j], 0, BEFORE_KEPT[role[:, j], now[:, j + 1]])
        found[(found < 0) & ((now[np.arange(n), first] & wanted) == wanted)] = k
        if (found >= 0).all():
            break
    return np.stack(made), found


def trace(bits: np.ndarray, codes: np.ndarray, lengths: np.ndarray, state: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edits as letters, a row for each step with 0 where an instance is through; last states), least letters first."""
    n, width = codes.shape
    at, state, left = width - lengths, state.copy(), cost.copy()
    out = []
    one = np.arange(n)

    def holds(k: np.ndarray, j: np.ndarray, s: np.ndarray) -> np.ndarray:
        return (k >= 0) & (s < 4) & (bits[np.maximum(k, 0), one, np.minimum(j, width)] >> np.minimum(s, 3) & 1 > 0)

    while (open_ := at < width).any():
        code = codes[one, np.minimum(at, width - 1)]
        cut = np.where(code > 3, CUT, 0)
        new, kept = NEXT[state], KEPT[code & 3, state]
        ways = [holds(left - DELETE, at + 1, state), holds(left - CHANGE, at, new), holds(left - cut, at + 1, kept), holds(left - CHANGE - cut, at + 1, new)]
        way = np.where(open_, np.stack(ways).argmax(axis=0), 4)
        out.append(np.array([*b"DIKR", 0], np.uint8)[way])
        left -= np.stack([np.full(n, DELETE), np.full(n, CHANGE), cut, CHANGE + cut, np.zeros(n, int)])[way, one]
        state = np.choose(way, [state, new, kept, new, state])
        at = at + np.isin(way, (0, 2, 3))
    return np.stack(out) if out else np.zeros((0, n), np.uint8), state


def _portions(turns: list[bytes], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers, right-aligned codes, lengths) of sequences of like lengths, so many that ``most`` layers stay within ``CELLS``."""
    sizes = np.array([len(t) for t in turns])
    for low, width in ((-1, 8), (8, 16), (16, 32), (32, BLOCK)):
        mine = np.flatnonzero((sizes > low) & (sizes <= width))
        step = max(1, CELLS // ((width + 1) * (most + 1)))
        for lo in range(0, len(mine), step):
            part = mine[lo : lo + step]
            codes = np.frombuffer(b"".join(turns[i].rjust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
            yield part, codes, sizes[part]


def repaired(turns: list[bytes], ends: np.ndarray, states: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(edits, last state) of each sequence of codes, from its state, with its costs after the end; cheapest, then least by letters."""
    edits: list[bytes] = [b""] * len(turns)
    last = states.copy()
    ends = ends - ends.min(axis=1, keepdims=True)
    open_ = np.arange(len(turns))
    most = 15
    while len(open_):
        again = []
        for part, codes, lengths in _portions([turns[i] for i in open_], most):
            mine = open_[part]
            bits, cost = layers(codes, lengths, ends[mine], 1 << states[mine], most)
            done = cost >= 0
            again.append(mine[~done])
            steps, after = trace(bits[:, done], codes[done], lengths[done], states[mine[done]], cost[done])
            last[mine[done]] = after
            for i, column in zip(mine[done], steps.T):
                edits[i] = column[column > 0].tobytes()
        open_, most = np.concatenate(again), 4 * most
    return edits, last


def passages(turns: list[bytes]) -> np.ndarray:
    """Costs from each state before a sequence to each state after it; ``FAR`` where there is no way."""
    out = np.full((len(turns), 4, 4), FAR)
    most = DELETE * BLOCK + 8
    for part, codes, lengths in _portions(turns, most):
        for e in range(4):
            ends = np.full((len(part), 4), FAR)
            ends[:, e] = 0
            bits, _ = layers(codes, lengths, ends, np.full(len(part), 31), most)  # no bitset has a fifth state, so all layers are made
            own = bits[:, np.arange(len(part)), codes.shape[1] - lengths]
            for s in range(4):
                hit = own >> s & 1 > 0
                out[part, s, e] = np.where(hit.any(axis=0), hit.argmax(axis=0), FAR)
    return out


FAR = 1 << 40


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, times) after a fixed damage: a hash of conversation and turn drops, empties, cuts, repeats or renames some. Nulls read as one space; a dropped turn has times 0."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20
    text = F.when(what == 1, "").when(what == 2, F.translate(blank(text_col), ".!?", "")).otherwise(blank(text_col))
    role = F.when(what == 4, "user").otherwise(blank(role_col))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(what == 0, 0).when(what == 3, 2).otherwise(1).cast("long").alias("times"))
    gone = F.col("times") == 0
    empty = {"turn": F.lit(None).cast("long"), "role": F.lit(" "), "text": F.lit(" ")}
    return rows.select("conv", *(F.when(gone, v).otherwise(F.col(c)).alias(c) for c, v in empty.items()), "times")


#: First fault of a turn.
SOUND, TRUNCATED, DUPLICATE, EMPTY = 0, 1, 2, 3
_SPACES = " \t\n\x0b\x0c\r"


def faulty(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, times, fault): equal rows as one, each with the first fault of its first copy; further copies are duplicates."""
    held = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("times").alias("times")).withColumn("end", F.right(F.rtrim("text", F.lit(_SPACES)), F.lit(1)))
    held = held.withColumn("mark", F.when((F.col("end") != "") & (F.col("times") > 0), F.sha2(F.concat_ws("\n", F.octet_length("role").cast("string"), "role", "text"), 256)))
    place = F.struct(F.col("turn").isNotNull().alias("set"), "turn")
    said = held.where("mark is not null").groupBy("conv", "mark").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("c"), F.col("mark").alias("m"), "first")
    both = held.join(said, held["conv"].eqNullSafe(said["c"]) & (held["mark"] == said["m"]), "left")
    fault = F.when(F.col("end") == "", EMPTY).when(place > F.col("first"), DUPLICATE).when(~F.col("end").isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    return both.select("conv", "turn", "role", "text", "times", fault.alias("fault"))


def _order() -> list[Column]:
    """(conv, turn, role, text) by short keys: long roles and texts take part by their beginnings, so that ranges are cut by small samples."""
    long_role = F.length("role") > 32
    return [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.left("role", F.lit(32)).asc(), long_role.asc(), F.when(long_role, "").otherwise(F.left("text", F.lit(32))).asc()]


FACTS = ["blank", "duplicate", "truncated", "illegal", "turns"]


class _Block:
    """Turns of one conversation that follow each other."""

    def __init__(self, conv: object, seq: int, whole: bool) -> None:
        self.conv, self.seq, self.whole = conv, seq, whole
        self.codes, self.roles, self.texts, self.gone = bytearray(), [], [], [0]
        self.facts = dict.fromkeys(FACTS, 0)
        self.low = self.high = self.first = self.last = None
        self.size = 0

    def add(self, turn: int | None, role: str, text: str, times: int, fault: int) -> None:
        if not times:
            return
        initial = role[:1]
        if self.last is None:
            self.first = initial
        else:
            self.facts["illegal"] += self.last + initial not in ("su", "ua", "au")
        self.facts["illegal"] += times - 1
        self.last = initial
        if turn is not None:
            self.facts["turns"] += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if fault == EMPTY:
            self.facts["blank"] += times
        else:
            self.facts["truncated"] += fault == TRUNCATED
            self.facts["duplicate"] += times - (fault != DUPLICATE)
        if fault in (EMPTY, DUPLICATE):
            self.gone[-1] += times
            return
        at = INITIALS.find(initial) if initial else -1
        self.codes.append((at if at >= 0 else 3) + (4 if fault == TRUNCATED else 0))
        self.roles.append(role)
        self.texts.append(text)
        self.gone.append(times - 1)
        self.size += len(text) + len(role)

    def row(self, pid: int, alone: bool) -> dict:
        return {"pid": pid, "seq": self.seq, "conv": self.conv, "alone": alone, "codes": bytes(self.codes), "roles": self.roles, "texts": self.texts, "gone": self.gone, "low": self.low, "high": self.high, "first": self.first, "last": self.last, **self.facts}


def blocks(rows: DataFrame) -> DataFrame:
    """Rows of ``faulty`` as blocks (pid, seq tell their order), stored; ``alone`` where a block is a whole conversation."""
    dealt = rows.repartitionByRange(*_order()).sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seq, now, out, size, kind, first = TaskContext.get().partitionId(), 0, None, [], 0, None, True
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, turn, role, text, times, fault in zip(*(c.to_pylist() for c in batch.columns)):
                other = now is not None and now.conv != conv
                if now is None or other or len(now.codes) == BLOCK or now.size >= BLOCK_BYTES:
                    if now is not None:
                        out.append(now.row(pid, other and now.whole and not first))
                        size += now.size
                        first = first and not other
                        if len(out) >= 2000 or size >= 4 * BLOCK_BYTES:
                            yield _batch(out, kind)
                            out, size = [], 0
                    now = _Block(conv, seq, now is None or other)
                    seq += 1
                now.add(turn, role, text, times, fault)
        if now is not None:
            out.append(now.row(pid, False))
        if out:
            yield _batch(out, kind)

    kind = rows.schema["conv"].dataType.simpleString()
    return stored(dealt.mapInArrow(run, f"pid int, seq long, conv {kind}, alone boolean, codes binary, roles array<string>, texts array<string>, gone array<long>, low long, high long, first string, last string, " + ", ".join(f"{c} long" for c in FACTS)), "blocks")


def _batch(rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
    whole = pa.int64()
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("pid", pa.int32()), ("seq", whole), ("conv", kind), ("alone", pa.bool_()), ("codes", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("gone", pa.list_(whole)), ("low", whole), ("high", whole), ("first", pa.string()), ("last", pa.string()), *((c, whole) for c in FACTS)]))


def linked(open_: DataFrame) -> DataFrame:
    """(pid, seq, state, ends) of the blocks of long conversations: the state before each, and the least costs after it from each state."""
    kind = open_.schema["conv"].dataType.simpleString()

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = passages(batch.column(3).to_pylist()).reshape(-1, 16)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.tolist(), pa.list_(pa.int64()))], names=[*batch.schema.names, "costs"])

    steps = stored(open_.select("conv", "pid", "seq", "codes").mapInArrow(costs, f"conv {kind}, pid int, seq long, codes binary, costs array<long>"), "steps")

    def joined(group: pd.DataFrame) -> pd.DataFrame:  # blocks of one conversation in one partition
        group = group.sort_values("seq")
        whole = np.where(np.eye(4, dtype=bool), 0, FAR)
        for m in group["costs"]:
            whole = np.minimum((whole[:, :, None] + np.reshape(m, (4, 4))[None]).min(axis=1), FAR)
        return pd.DataFrame({"conv": group["conv"].iloc[:1], "pid": group["pid"].iloc[:1], "costs": [whole.ravel().tolist()]})

    def after(group: pd.DataFrame) -> pd.DataFrame:  # one conversation: a row for each partition it is in
        group = group.sort_values("pid")
        ends, out = ENDING, []
        for m in reversed(group["costs"].tolist()):
            out.append(ends.tolist())
            ends = (np.reshape(m, (4, 4)) + ends[None]).min(axis=1)
        return pd.DataFrame({"conv": group["conv"], "pid": group["pid"], "ends": out[::-1]})

    parts = steps.groupBy("conv", "pid").applyInPandas(joined, f"conv {kind}, pid int, costs array<long>")
    tails = parts.groupBy("conv").applyInPandas(after, f"conv {kind}, pid int, ends array<long>")

    def paths(group: pd.DataFrame) -> pd.DataFrame:  # blocks of one conversation in one partition
        group = group.sort_values("seq")
        ends, out = np.array(group["ends"].iloc[0]), []
        for m in reversed(group["costs"].tolist()):
            out.append(ends)
            ends = (np.reshape(m, (4, 4)) + ends[None]).min(axis=1)
        ends = np.array(out[::-1])
        n = len(group)
        _, last = repaired([c for c in group["codes"] for _ in range(4)], np.repeat(ends, 4, axis=0), np.tile(np.arange(4), n))
        before, now = [], np.arange(4)
        for row in last.reshape(n, 4):
            before.append(now.tolist())
            now = row[now]
        return pd.DataFrame({"conv": group["conv"], "pid": group["pid"], "seq": group["seq"], "ends": ends.tolist(), "before": before, "through": [now.tolist()] * n, "head": np.arange(n) == 0})

    known = steps.join(tails.select(F.col("conv").alias("c"), F.col("pid").alias("p"), "ends"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("pid") == F.col("p"))).drop("c", "p")
    ways = stored(known.groupBy("conv", "pid").applyInPandas(paths, f"conv {kind}, pid int, seq long, ends array<long>, before array<int>, through array<int>, head boolean"), "ways")

    def entered(group: pd.DataFrame) -> pd.DataFrame:  # one conversation: a row for each partition it is in
        group = group.sort_values("pid")
        state, out = 0, []
        for through in group["through"]:
            out.append(state)
            state = int(through[state])
        return pd.DataFrame({"c": group["conv"], "p": group["pid"], "entry": out})

    entries = ways.where("head").select("conv", "pid", "through").groupBy("conv").applyInPandas(entered, f"c {kind}, p int, entry int")
    return ways.join(entries, F.col("conv").eqNullSafe(F.col("c")) & (F.col("pid") == F.col("p"))).select("pid", "seq", F.element_at("before", F.col("entry") + 1).alias("state"), "ends")


def _written(edits: bytes, state: int, roles: list[str], texts: list[str], codes: bytes, gone: list[int]) -> tuple[str, int, list[str]]:
    """(audit, cost, repaired turns) of one block by its edits."""
    audit, cost, lines, i = ["D" * gone[0]], DELETE * sum(gone), [], 0
    for e in edits.decode():
        audit.append(e)
        cost += {"D": DELETE, "I": CHANGE, "K": 0, "R": CHANGE}[e]
        if e in "IR":
            lines.append(f"{NAMES[state]}:{texts[i] if e == 'R' else ''}")
            state = int(NEXT[state])
        elif e == "K":
            lines.append(f"{roles[i]}:{texts[i]}")
            state = int(KEPT[codes[i] & 3, state])
        if e != "I":
            cost += CUT if e != "D" and codes[i] > 3 else 0
            i += 1
            audit.append("D" * gone[i])
    return "".join(audit), cost, lines


def _ending(state: int) -> tuple[str, int, list[str]]:
    """What is inserted at a conversation's end."""
    n = int(ENDING[state]) // CHANGE
    return "I" * n, CHANGE * n, [f"{name}:" for name in ("user", "assistant")[2 - n :]]


RESULT = ["gaps", *FACTS[:4], "cost", "audit", "repaired_sha256"]


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else min(high - low + 1 - turns, (1 << 63) - 1)


def _result_type(kind: str) -> str:
    return f"conv {kind}, " + ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'long'}" for c in RESULT)


def _alone(rows: DataFrame) -> DataFrame:
    """Results of conversations that are one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            n, out = batch.num_rows, {c: [] for c in RESULT}
            edits, last = repaired(d["codes"], np.tile(ENDING, (n, 1)), np.zeros(n, np.int64))
            for i in range(n):
                audit, cost, lines = _written(edits[i], 0, d["roles"][i], d["texts"][i], d["codes"][i], d["gone"][i])
                more = _ending(int(last[i]))
                body = "\n".join(lines + more[2]).encode()
                row = [_gaps(d["low"][i], d["high"][i], d["turns"][i]), *(d[c][i] for c in FACTS[:4]), cost + more[1], audit + more[0], hashlib.sha256(body).hexdigest()]
                for c, v in zip(RESULT, row):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([batch.column("conv"), *(pa.array(v, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c, v in out.items())], names=["conv", *RESULT])

    return rows.mapInArrow(run, _result_type(rows.schema["conv"].dataType.simpleString()))


def _in_order(rows: DataFrame) -> DataFrame:
    """Results of conversations of several blocks: each block is repaired where it lies, then pieces meet in order and only hashes and counts are kept of them."""
    kind = rows.schema["conv"].dataType.simpleString()
    facts = ["low", "high", "first", "last", *FACTS]
    types = {"low": "long", "high": "long", "first": "string", "last": "string", **dict.fromkeys(FACTS, "long")}

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, n = batch.to_pydict(), batch.num_rows
            states = np.array(d["state"], np.int64)
            edits, last = repaired(d["codes"], np.array(d["ends"], np.int64).reshape(n, 4), states)
            made = [_written(edits[i], int(states[i]), d["roles"][i], d["texts"][i], d["codes"][i], d["gone"][i]) for i in range(n)]
            body = [("\n".join(m[2]).encode() if m[2] else None) for m in made]
            yield pa.RecordBatch.from_arrays([
                batch.column("conv"), batch.column("pid"), batch.column("seq"), *(batch.column(c) for c in facts), pa.array([m[0] for m in made], pa.string()),
                pa.array([m[1] for m in made], pa.int64()), pa.array(body, pa.binary()), pa.array(last.astype(np.int32)),
            ], names=["conv", "pid", "seq", *facts, "audit", "cost", "body", "state"])

    links = linked(rows)
    with_links = rows.join(links.withColumnsRenamed({"pid": "p", "seq": "s"}), (F.col("pid") == F.col("p")) & (F.col("seq") == F.col("s"))).drop("p", "s")
    made = with_links.mapInArrow(pieces, f"conv {kind}, pid int, seq long, " + ", ".join(f"{c} {types[c]}" for c in facts) + ", audit string, cost long, body binary, state int")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, arrow = None, None

        def closed(x: dict) -> pa.RecordBatch:
            more = _ending(x["state"])
            for line in more[2]:
                x["hash"].update((b"\n" if x["any"] else b"") + line.encode())
                x["any"] = True
            row = [_gaps(x["low"], x["high"], x["turns"]), *(x[c] for c in FACTS[:4]), x["cost"] + more[1], "".join([*x["audit"], more[0]]), x["hash"].hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([x["conv"]], arrow), *(pa.array([v]) for v in row)], names=["conv", *RESULT])

        for batch in batches:
            arrow = batch.schema.field("conv").type
            for r in batch.to_pylist():
                if now is not None and now["conv"] != r["conv"]:
                    yield closed(now)
                    now = None
                if now is None:
                    now = {"conv": r["conv"], "hash": hashlib.sha256(), "any": False, "audit": [], "cost": 0, "low": None, "high": None, "last": None, **dict.fromkeys(FACTS, 0)}
                for c in FACTS:
                    now[c] += r[c]
                now["turns"] -= r["low"] is not None and r["low"] == now["high"]
                now["low"] = r["low"] if now["low"] is None else now["low"]
                now["high"] = now["high"] if r["high"] is None else r["high"]
                if r["first"] is not None:
                    now["illegal"] += now["last"] is not None and now["last"] + r["first"] not in ("su", "ua", "au")
                    now["last"] = r["last"]
                now["cost"] += r["cost"]
                now["audit"].append(r["audit"])
                now["state"] = r["state"]
                if r["body"] is not None:
                    now["hash"].update((b"\n" if now["any"] else b"") + r["body"])
                    now["any"] = True
        if now is not None:
            yield closed(now)

    return made.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "pid", "seq").mapInArrow(joined, _result_type(kind))


def repair(rows: DataFrame) -> DataFrame:
    """(conv, ``RESULT``) of every conversation in ``rows`` (conv, turn, role, text, times).

    Turns are taken in order of their number, nulls first; turns with one number by role and text. A row stands for ``times`` equal
    turns; one of a conversation without turns has times 0. A role without a character, or with another initial than s, u or a, can't be kept.
    """
    held = blocks(faulty(rows))
    return _alone(held.where("alone")).union(_in_order(held.where("not alone")))


def conversation_repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation, after damage; see ``damaged`` and ``repair``.

    A null conversation is one conversation; repeated rows are duplicates, extra columns take no part, an empty table gives no rows.
    """
    return repair(damaged(turns, conv_col, turn_col, role_col, text_col)).withColumnRenamed("conv", conv_col)
