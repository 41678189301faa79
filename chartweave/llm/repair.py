"""Repair of conversation structure by a chunked, rank-convergent Viterbi search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.llm.common import SPACES, small_batches
from chartweave.scale import literal_table
from chartweave.session import materialise

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Different rows and characters of a chunk.
ROWS, CHARS = 512, 1 << 20
#: What a kept row may be in a state, and the state after it: nothing yet, after s, after u, after a.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role and state that rerole and insert lead to.
PUT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
#: Costs at the end of a conversation: nothing or whole pairs may end it, otherwise turns are inserted.
END = (0, 2 * INSERT, INSERT, 0)
#: What a chunk in the middle of a conversation supposes behind it at first.
SUPPOSED = (0, 0, 0, 0)
#: Faults of a row, as bits beside its initial.
BLANK, DUPLICATE, CUT = 4, 8, 16
INITIALS = ("", "s", "u", "a")


# ------------------------------------------------------------- one chunk
def step(flag: int, copies: int, after: tuple) -> tuple:
    """Cheapest costs from before a row (and its further copies, which are deleted) for each state, given those behind it."""
    if flag & (BLANK | DUPLICATE):
        return tuple(v + DELETE * copies for v in after)
    rest, stays, initial = DELETE * (copies - 1), TRUNCATED if flag & CUT else 0, INITIALS[flag & 3]
    raw = []
    for state in range(4):
        best = min(DELETE + after[state], REROLE + stays + after[PUT[state][1]])
        if initial in KEPT[state]:
            best = min(best, stays + after[KEPT[state][initial]])
        raw.append(best + rest)
    u, a = min(raw[2], INSERT + raw[3]), min(raw[3], INSERT + raw[2])
    return min(raw[0], INSERT + u), min(raw[1], INSERT + u), u, a


def costs(flags: bytes, copies: list[int], right: tuple) -> list[tuple]:
    """Cheapest costs before every row of a chunk, and behind the last."""
    out = [right]
    for flag, n in zip(reversed(flags), reversed(copies), strict=True):
        out.append(step(flag, n, out[-1]))
    return out[::-1]


def trace(flags: bytes, copies: list[int], vectors: list[tuple], state: int, last: bool) -> tuple[list[str], int]:
    """Letters of the cheapest edits from ``state``, the least in ASCII order, one entry per row with the inserts before it; the state behind them.

    Each next letter is the smallest that still reaches the cheapest cost. The last
    chunk has one more entry for the inserts at the end.
    """
    out = []
    for n, (flag, many) in enumerate(zip(flags, copies, strict=True)):
        after, letters = vectors[n + 1], ""
        rest, stays = DELETE * (many - 1), TRUNCATED if flag & CUT else 0
        while True:
            if vectors[n][state] == DELETE + rest + after[state]:
                letters += "D"
                break
            if vectors[n][state] == INSERT + vectors[n][PUT[state][1]]:
                letters, state = letters + "I", PUT[state][1]
                continue
            to = KEPT[state].get(INITIALS[flag & 3])
            if to is not None and vectors[n][state] == stays + rest + after[to]:
                letters, state = letters + "K", to
            else:
                letters, state = letters + "R", PUT[state][1]
            break
        out.append(letters + "D" * (many - 1))
    if last:
        letters = ""
        while END[state]:
            letters, state = letters + "I", PUT[state][1]
        out.append(letters)
    return out, state


def turns(letters: list[str], roles: list[str], texts: list[str], state: int) -> list[tuple[str, str]]:
    """The repaired (role, text) of a chunk's letters."""
    out = []
    for n, own in enumerate(letters):
        for letter in own:
            if letter == "K":
                out.append((roles[n], texts[n]))
                state = KEPT[state][roles[n][:1]]
            elif letter in "IR":
                role, state = PUT[state]
                out.append((role, "" if letter == "I" else texts[n]))
    return out


def normal(vector: tuple) -> tuple:
    """A vector up to a constant."""
    least = min(vector)
    return tuple(v - least for v in vector)


# ------------------------------------------------------------- rows and chunks
def damage_code(conv: Column, turn: Column) -> Column:
    """What happens to a row in the trial: the CRC of its id and turn (a space for null) modulo 20."""
    named = [F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv, turn)]
    return F.crc32(F.encode(F.concat(named[0], F.lit(":"), named[1]), "UTF-8")) % 20


def rows_of(conversations: DataFrame, damaged: bool = False) -> DataFrame:
    """(conv_id, turn, role, text, copies, gone): different rows with how often they stand there; null role and text are one space.

    Equal rows are counted before anything is shuffled by conversation. ``damaged``
    applies the trial's faults; rows it drops stay marked, so that their conversation does.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    counted = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text")).groupBy(
        "conv_id", "turn", "role", "text"
    ).agg(F.count(F.lit(1)).alias("copies"))
    if not damaged:
        return counted.withColumn("gone", F.lit(False))
    code = F.col("code")
    return counted.withColumn("code", damage_code(F.col("conv_id"), F.col("turn"))).select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(code == 1, "").when(code == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(code == 3, 2 * F.col("copies")).otherwise(F.col("copies")).alias("copies"), (code == 0).alias("gone"),
    )


def _flag(role: str, text: str) -> int:
    left = text.strip(SPACES)
    initial = INITIALS.index(role[:1]) if role[:1] in INITIALS else 0
    return initial | (BLANK if not left else 0 if left[-1] in ".!?" else CUT)


def digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def chunks(rows: DataFrame, most_rows: int = ROWS, most_chars: int = CHARS) -> DataFrame:
    """Conversations in order of their turns (nulls first, then role and text), cut into chunks of bounded rows and characters.

    Range partitions by conversation and turn, so that a long conversation is spread
    over many tasks. open: whether the conversation may go on in the chunk before or
    behind. part and seq give the chunks' order over the whole table. Rows that
    repeat role and text are marked within a chunk; digests of the others are kept
    for open chunks.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    fields = "part int, seq int, open boolean, flags binary, copies array<long>, roles array<string>, texts array<string>, digests array<binary>, turns array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, now, held, begun = TaskContext.get().partitionId(), 0, None, None, True
        ready: list[tuple] = []
        schema = None

        def closed(after: bool) -> tuple:
            nonlocal seq
            flags, copies, roles, texts, own, at, _, before = held
            seq += 1
            opened = before or after
            return now, part, seq - 1, opened, bytes(flags), copies, roles, texts, own if opened else None, at

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*ready, strict=True), schema, strict=True)], schema=schema)
            ready.clear()
            return out

        fresh = lambda before: ([], [], [], [], [], [], {"chars": 0, "seen": set()}, before)
        for batch in batches:
            if schema is None:
                text, number = pa.list_(pa.string()), pa.list_(pa.int64())
                schema = pa.schema([
                    ("conv_id", batch.schema.field("conv_id").type), ("part", pa.int32()), ("seq", pa.int32()), ("open", pa.bool_()), ("flags", pa.binary()),
                    ("copies", number), ("roles", text), ("texts", text), ("digests", pa.list_(pa.binary())), ("turns", number),
                ])
            for conv, turn, role, text, many, gone in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "gone")), strict=True):
                if held is None or conv != now:
                    if held is not None:
                        ready.append(closed(False))
                    now, held, begun = conv, fresh(begun), False
                if gone:
                    continue
                if len(held[0]) >= most_rows or (held[0] and held[6]["chars"] + len(text) > most_chars):
                    ready.append(closed(True))
                    held = fresh(True)
                if len(ready) >= 256:
                    yield told()
                flag, own = _flag(role, text), digest(role, text)
                if not flag & BLANK and own in held[6]["seen"]:
                    flag = flag & 3 | DUPLICATE
                held[6]["seen"].add(own)
                held[6]["chars"] += len(text)
                for column, value in zip(held, (flag, many, role, text, own, turn), strict=False):
                    column.append(value)
        if held is not None:
            ready.append(closed(True))
        if ready:
            yield told()

    small_batches(rows.sparkSession)
    # The first characters of a text are enough to place it; whole texts would go to the driver as samples.
    keys = ["conv_id", "turn", "role", F.substring("text", 1, 32)]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {kind}, {fields}")


@dataclass(frozen=True)
class Repaired:
    """Chunks of repaired conversations: those that hold a whole one, and the parts of the others."""

    whole: DataFrame
    parts: DataFrame

    def turns(self) -> DataFrame:
        """(conv_id, idx, n, role, text): the repaired turns, in order of idx and n within a conversation."""
        return self.whole.unionByName(self.parts).select("conv_id", "idx", F.posexplode("repaired").alias("n", "t")).select("conv_id", "idx", "n", "t.role", "t.text")

    def verdicts(self) -> DataFrame:
        """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

        Parts of a conversation pass through one task in order, one at a time: a digest
        of its text has no other way. Nothing of them is kept but counts and the audit.
        """
        kind = self.whole.schema["conv_id"].dataType.simpleString()
        counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        schema = f"conv_id {kind}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, state, ready, kinds = None, None, [], None

            def told() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*ready, strict=True), kinds, strict=True)], schema=kinds)

            for batch in batches:
                kinds = kinds or pa.schema([("conv_id", batch.schema.field("conv_id").type), *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())])
                for row in batch.to_pylist():
                    if state is None or row["conv_id"] != now:
                        if state is not None:
                            ready.append((now, *state.done()))
                        now, state = row["conv_id"], _Sum()
                    state.add(row)
                if ready:
                    yield told()
                    ready = []
            if state is not None:
                ready.append((now, *state.done()))
                yield told()

        small_batches(self.whole.sparkSession, 64)
        together = self.parts.repartition("conv_id").sortWithinPartitions("conv_id", "idx")
        return self.whole.mapInArrow(run, schema).unionByName(together.mapInArrow(run, schema))


class _Sum:
    """What a conversation's chunks add up to, in their order."""

    def __init__(self) -> None:
        self.hash, self.any, self.audit, self.counts, self.cost = hashlib.sha256(), False, [], [0, 0, 0, 0], 0
        self.low = self.high = self.turn = self.last = None
        self.distinct = 0

    def add(self, row: dict) -> None:
        self.audit.append(row["audit"])
        self.cost += row["cost"]
        for flag, many, turn in zip(row["flags"], row["copies"], row["turns"], strict=True):
            if turn is not None and turn != self.turn:
                self.distinct, self.turn, self.high = self.distinct + 1, turn, turn
                self.low = turn if self.low is None else self.low
            first = 0 if flag & BLANK else 1 if flag & DUPLICATE else 2 if flag & CUT else None
            if first is not None:
                self.counts[first] += 1
            self.counts[0 if flag & BLANK else 1] += many - 1
            own = INITIALS[flag & 3]
            self.counts[3] += many - 1 + (self.last is not None and self.last + own not in ("su", "ua", "au"))
            self.last = own
        for turn in row["repaired"]:
            self.hash.update((("\n" if self.any else "") + f"{turn['role']}:{turn['text']}").encode())
            self.any = True

    def done(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, *self.counts, self.cost, "".join(self.audit), self.hash.hexdigest()


def _numbered(table: DataFrame) -> DataFrame:
    """Chunks with idx, their place in the whole table; the driver counts the chunks of every range partition."""
    counts = sorted((r.part, r.n) for r in table.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, at = [], 0
    for part, n in counts:
        starts.append((part, at))
        at += n
    offsets = literal_table(table.sparkSession, starts, "part int, start long")
    return table.join(F.broadcast(offsets), "part").withColumn("idx", F.col("start") + F.col("seq"))  # one row per partition


def _mark_repeats(parts: DataFrame) -> DataFrame:
    """Rows that repeat role and text of an earlier part of their conversation, marked as duplicates."""
    rows = parts.select("conv_id", "idx", F.posexplode("digests").alias("at", "own"))
    first = rows.groupBy("conv_id", "own").agg(F.min("idx").alias("first"), F.max("idx").alias("final")).where("final > first").select(
        F.col("conv_id").alias("_conv"), F.col("own").alias("_own"), "first"
    )
    late = rows.join(first, rows["conv_id"].eqNullSafe(first["_conv"]) & (rows["own"] == first["_own"])).where("idx > first")
    marks = late.groupBy("idx").agg(F.collect_list("at").alias("late"))
    kinds = parts.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for flags, late in zip(batch.column("flags").to_pylist(), batch.column("late").to_pylist(), strict=True):
                own = bytearray(flags)
                for at in late or []:
                    own[at] = own[at] if own[at] & BLANK else own[at] & 3 | DUPLICATE
                out.append(bytes(own))
            batch = batch.drop_columns(["late"])
            yield batch.set_column(batch.schema.get_field_index("flags"), "flags", pa.array(out, pa.binary()))

    return parts.join(marks, "idx", "left").select(*kinds.names, "late").mapInArrow(run, kinds)


def _reran(asked: DataFrame) -> DataFrame:
    """(idx, vin, vout, shift) of (idx, flags, copies, vin): the vector before a chunk, less its least cost, for each vector behind it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for idx, flags, copies, right in zip(*(batch.column(c).to_pylist() for c in ("idx", "flags", "copies", "vin")), strict=True):
                left = costs(flags, copies, tuple(right))[0]
                rows.append((idx, right, list(normal(left)), min(left)))
            names, kinds = ["idx", "vin", "vout", "shift"], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], names=names)

    return asked.select("idx", "flags", "copies", "vin").mapInArrow(run, "idx long, vin array<long>, vout array<long>, shift long")


def _settled(parts: DataFrame) -> DataFrame:
    """Fix-up passes: (idx, vin, vout, shift) for every vector, up to a constant, that can stand behind a part.

    Every part starts from a supposed vector (the last of a conversation from the true
    one). What its follower yields is run again only if it differs from all vectors
    run so far by more than a constant; there are few such classes, so passes end.
    """
    vector = lambda v: F.array(*[F.lit(x).cast("long") for x in v])
    known = materialise(_reran(parts.withColumn("vin", F.when(F.col("following"), vector(SUPPOSED)).otherwise(vector(END)))))
    fresh = known
    follows = parts.where("followed").select((F.col("idx") - 1).alias("before"), "idx")
    while True:
        asks = fresh.join(follows, "idx").select(F.col("before").alias("idx"), F.col("vout").alias("vin")).distinct()
        asks = materialise(asks.join(known.select("idx", "vin"), ["idx", "vin"], "left_anti"))
        if asks.isEmpty():
            return known
        fresh = materialise(_reran(parts.select("idx", "flags", "copies").join(asks, "idx")))
        known = known.unionByName(fresh)


def _stitched(known: DataFrame, parts: DataFrame) -> DataFrame:
    """(idx, right): the true vector behind every part, up to a constant, from the last part of a conversation to its first.

    A stream of a few numbers per part; no more than one part's vectors are held.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, true, seen = None, END, {}
        for batch in batches:
            out = []
            for idx, following, vin, vout in zip(*(batch.column(c).to_pylist() for c in ("idx", "following", "vin", "vout")), strict=True):
                if idx != now:
                    true = seen[true] if following else END
                    now, seen = idx, {}
                    out.append((idx, list(true)))
                seen[tuple(vin)] = tuple(vout)
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.int64()))], names=["idx", "right"])

    small_batches(parts.sparkSession, 10_000)
    rows = known.join(parts.select("idx", "conv_id", "following"), "idx")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("idx")).mapInArrow(run, "idx long, right array<long>")


def _started(parts: DataFrame) -> DataFrame:
    """(idx, state): the state in which every part begins: each is traced from all four, then they are chained from the first."""
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for flags, copies, right in zip(*(batch.column(c).to_pylist() for c in ("flags", "copies", "right")), strict=True):
                vectors = costs(flags, copies, tuple(right))
                out.append([trace(flags, copies, vectors, s, False)[1] for s in range(4)])
            kept = batch.select(["idx", "conv_id", "followed"])
            yield kept.append_column("ends", pa.array(out, pa.list_(pa.int32())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = 0
        for batch in batches:
            out = []
            for followed, own in zip(batch.column("followed").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                state = state if followed else 0
                out.append(state)
                state = own[state]
            yield pa.RecordBatch.from_arrays([batch.column("idx"), pa.array(out, pa.int32())], names=["idx", "state"])

    small_batches(parts.sparkSession, 10_000)
    kind = parts.schema["conv_id"].dataType.simpleString()
    traced = parts.select("idx", "conv_id", "followed", "flags", "copies", "right").mapInArrow(ends, f"idx long, conv_id {kind}, followed boolean, ends array<int>")
    return traced.repartition("conv_id").sortWithinPartitions("conv_id", "idx").mapInArrow(run, "idx long, state int")


def _edited(table: DataFrame) -> DataFrame:
    """Chunks (idx, conv_id, flags, copies, turns, roles, texts, right, state, following) with their audit, cost and repaired turns."""
    kind = table.schema["conv_id"].dataType.simpleString()
    kept = ["conv_id", "idx", "flags", "copies", "turns"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits, spent, repaired = [], [], []
            for row in batch.select(["flags", "copies", "roles", "texts", "right", "state", "following"]).to_pylist():
                vectors = costs(row["flags"], row["copies"], tuple(row["right"]))
                letters, end = trace(row["flags"], row["copies"], vectors, row["state"], not row["following"])
                audits.append("".join(letters))
                spent.append(vectors[0][row["state"]] - (row["right"][end] if row["following"] else 0))
                repaired.append([{"role": r, "text": t} for r, t in turns(letters, row["roles"], row["texts"], row["state"])])
            out = batch.select(kept)
            struct = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            for name, values, what in (("audit", audits, pa.string()), ("cost", spent, pa.int64()), ("repaired", repaired, struct)):
                out = out.append_column(name, pa.array(values, what))
            yield out

    schema = f"conv_id {kind}, idx long, flags binary, copies array<long>, turns array<long>, audit string, cost long, repaired array<struct<role:string,text:string>>"
    return table.mapInArrow(run, schema)


def repair(conversations: DataFrame, damaged: bool = False, most_rows: int = ROWS, most_chars: int = CHARS) -> Repaired:
    """Cheapest repair of every conversation of ``conversations`` (conv_id, turn, role, text) to ``(s?(ua)+)?``.

    A row is kept (0), reroled to user or assistant (1) or deleted (2; blank and repeated
    rows always are), turns without text may be inserted anywhere (5), and a truncated
    row that stays costs 5 more; of equal costs the least audit letters win. Rows go by
    turn (nulls first), then role, then text; null role and text are one space, a null
    conv_id is a conversation of its own, roles with other initials can only be reroled
    or deleted. A repeated row counts as often as it stands there. An empty table gives
    no rows; other columns are ignored.

    Most conversations lie in one chunk and are repaired where it lies. Those in several
    go through fix-up passes over their chunks (:func:`_settled`), so a conversation may
    be as long as the table; repeats between chunks are found by 128-bit digests.
    """
    spark = conversations.sparkSession
    table = _numbered(materialise(chunks(rows_of(conversations, damaged), most_rows, most_chars)))
    ends = table.where("open").select("idx", "conv_id")
    other = ends.select(F.col("idx").alias("_idx"), F.col("conv_id").alias("_conv"))
    pairs = materialise(ends.join(other, (ends["idx"] == other["_idx"] + 1) & ends["conv_id"].eqNullSafe(other["_conv"])).select("idx"))
    sides = pairs.select("idx", F.lit(True).alias("followed"), F.lit(False).alias("following")).unionByName(
        pairs.select(F.col("idx") - 1, F.lit(False), F.lit(True)).toDF("idx", "followed", "following")
    ).groupBy("idx").agg(F.max("followed").alias("followed"), F.max("following").alias("following"))
    own = ["idx", "conv_id", "flags", "copies", "turns", "roles", "texts"]
    small_batches(spark, 64)
    parts = materialise(_mark_repeats(table.where("open").join(sides, "idx").select(*own, "digests", "followed", "following")))
    known = _settled(parts)
    right = materialise(_stitched(known, parts))
    traced = materialise(parts.drop("digests").join(right, "idx"))
    state = materialise(_started(traced))
    small_batches(spark, 64)
    alone = table.join(sides, "idx", "left_anti").select(
        *own, F.array(*[F.lit(v).cast("long") for v in END]).alias("right"), F.lit(0).alias("state"), F.lit(False).alias("following")
    )
    return Repaired(_edited(alone), _edited(traced.join(state, "idx").select(*alone.columns)))
