"""Repair of conversation structure by iterative-deepening A*.

Spark finds the faults of each row (blank, duplicate, truncated) and sorts the
rows of a conversation into one run of rows, of which the search needs a byte
each. The search reads rows in order and edits them so that the roles become an
optional system turn and then pairs of user and assistant. It goes depth first,
in ASCII order of the edits' initials, under a bound of cost that rises until a
path is found; a table keeps, for each state that failed, the least cost that it
would need. So the first path found is the cheapest, and of those the least.
The texts then stream past the edits once more, in the same order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What edits cost. Keep costs nothing; a truncated row that isn't deleted costs CUT besides.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: White space: a row of nothing else is blank.
SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
_KIND = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: What may follow what, and the role that a state wants next.
FOLLOWS = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
WANTED = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Rows of a byte: the kind of role, whether it has to go, whether it is truncated.
GONE, SHORT = 4, 8
#: Long conversations are searched from every so many rows, from the last on, so that no search goes deeper.
STRIDE = 32
_FAR = 1 << 60
#: What is counted for each conversation.
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Search:
    """Iterative deepening over states (rows read, last role). ``low`` has what each state needs at least, ``sure`` says where that is exact."""

    def __init__(self, rows: bytes):
        self.rows, n = rows, len(rows)
        self.n = n
        # what the faults of the rows cost at least, from each row on, and the next row that may stay
        self.base, self.free = [0] * (n + 1), [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            self.base[i] = self.base[i + 1] + (DELETE if rows[i] & GONE else CUT if rows[i] & SHORT else 0)
            self.free[i] = self.free[i + 1] if rows[i] & GONE else i
        self.low, self.sure = [0] * (4 * (n + 1)), bytearray(4 * (n + 1))
        for q in range(4):
            self.low[4 * n + q] = self._clash(q, n, False)

    def bound(self, start: int, end: int) -> None:
        """Sets ``low`` for rows from ``start`` to ``end``, where it is exact: the faults, and neighbours that can't stay as they are, each row in one pair at most."""
        rows, base, free, last = self.rows, self.base, self.free, end == self.n
        rest = min(self.low[4 * end : 4 * end + 4]) - base[end]
        pairs = [0] * (end - start + 2)
        for i in range(end - 1, start - 1, -1):
            here, j = i - start, free[i]
            after = pairs[min(j + 1, end) - start]
            if j == i:
                k = free[i + 1]
                met = self._clash(rows[i] & 3, k, bool(rows[i] & SHORT)) + pairs[min(k + 1, end) - start] if k < end or last else 0
                pairs[here] = max(pairs[here + 1], met)
            else:
                pairs[here] = pairs[here + 1]
            for q in range(4):
                met = self._clash(q, j, False) + after if j < end or last else 0
                self.low[4 * i + q] = base[i] + rest + max(pairs[here], met)

    def _clash(self, q: int, j: int, short: bool) -> int:
        """What it costs at least that role ``q`` meets row ``j``, or the end; deleting a truncated row costs 1 more than keeping it."""
        if j >= self.n:
            return 0 if q in (START, ASSISTANT) else 1 if short else INSERT
        if (q, self.rows[j] & 3) in FOLLOWS:
            return 0
        return DELETE - CUT if short or self.rows[j] & SHORT else min(REROLE, INSERT)

    def edits(self, state: int) -> list[tuple[str, int, int]]:
        """(initial, cost, state after it) in ASCII order."""
        i, q = divmod(state, 4)
        want = WANTED[q]
        out = [("D", DELETE, state + 4)] if i < self.n else []
        out.append(("I", INSERT, 4 * i + want))
        if i < self.n and not self.rows[i] & GONE:
            kind, cut = self.rows[i] & 3, CUT if self.rows[i] & SHORT else 0
            if (q, kind) in FOLLOWS:
                out.append(("K", cut, 4 * (i + 1) + kind))
            if kind != want:
                out.append(("R", REROLE + cut, 4 * (i + 1) + want))
        return out

    def reach(self, state: int, budget: int) -> bool:
        """Whether a path from ``state`` ends well within ``budget``, which is never more than its least cost."""
        low, sure = self.low, self.sure
        if low[state] > budget:
            return False
        stack = [[state, budget, self.edits(state), 0, _FAR]]
        while stack:
            top = stack[-1]
            at, left, edits, k, least = top
            if sure[at] or (at >> 2 == self.n and at & 3 in (START, ASSISTANT)):
                for s, b, *_ in stack:
                    low[s], sure[s] = b, 1
                return True
            while k < len(edits):
                _, cost, then = edits[k]
                k += 1
                if cost + low[then] <= left:
                    top[3], top[4] = k - 1, least  # taken up again with what it needs at least
                    stack.append([then, left - cost, self.edits(then), 0, _FAR])
                    break
                least = min(least, cost + low[then])
            else:
                low[at] = max(low[at], least)
                stack.pop()
        return False

    def cost(self, state: int) -> int:
        while not self.sure[state]:
            self.reach(state, self.low[state])
        return self.low[state]

    def run(self) -> tuple[int, str]:
        """(least cost, the least of the cheapest edits' initials)."""
        end = self.n
        for start in range((max(0, self.n - 1) // STRIDE) * STRIDE, -1, -STRIDE):
            self.bound(start, end)
            for q in range(4 if start else 1):
                self.cost(4 * start + q)
            end = start
        state, left, audit = START, self.cost(START), []
        total = left
        while not (state >> 2 == self.n and state & 3 in (START, ASSISTANT)):
            for what, cost, then in self.edits(state):
                if self.reach(then, left - cost):
                    audit.append(what)
                    state, left = then, left - cost
                    break
        return total, "".join(audit)


def _ordered(df: DataFrame, *order) -> DataFrame:
    """The rows of each conversation together, in order."""
    return df.repartition("key").sortWithinPartitions("key", *order)


def with_faults(rows: DataFrame) -> DataFrame:
    """(key, turn, role, digest, text) with the first fault of each row: ``fault`` is 0, 1 blank, 2 duplicate or 3 truncated."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    nth = F.row_number().over(Window.partitionBy("key", "role", "digest").orderBy(F.col("turn").asc_nulls_first()))
    last = F.right(trimmed, F.lit(1))
    narrow = rows.select("key", "turn", "role", "digest", (trimmed == "").alias("blank"), (~last.isin(".", "!", "?")).alias("short"))
    return narrow.withColumn("fault", F.when(F.col("blank"), 1).when(nth > 1, 2).when(F.col("short"), 3).otherwise(0)).drop("blank", "short")


def _plan(rows: DataFrame, kind: str) -> DataFrame:
    """Per conversation its counts, the cost and the edits. A byte per row is held until the conversation ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None
        out: list[dict] = []

        def ended() -> None:
            cost, audit = Search(bytes(state["rows"])).run()
            gaps = state["turn"] - state["least"] + 1 - state["turns"] if state["turns"] else 0
            out.append({"key": state["key"], "gaps": gaps, "blank": state[1], "duplicate": state[2], "truncated": state[3], "illegal": state["illegal"], "cost": cost, "audit": audit})

        def flushed() -> pa.RecordBatch:
            rows, out[:] = out[:], []
            return pa.RecordBatch.from_pylist(rows, schema)

        schema = None
        for b in batches:
            types = [pa.int64()] * 6
            schema = schema or pa.schema([("key", b.column(0).type), *zip(COUNTS, types, strict=True), ("audit", pa.string())])
            for key, at, role, fault in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or state["key"] != key:
                    if state is not None:
                        ended()
                    state = {"key": key, "rows": bytearray(), "last": None, "illegal": 0, "turns": 0, "turn": None, "least": None, 1: 0, 2: 0, 3: 0}
                if at is not None and at != state["turn"]:
                    state["least"] = at if state["least"] is None else state["least"]
                    state["turn"] = at
                    state["turns"] += 1
                if fault:
                    state[fault] += 1
                if state["last"] is not None and state["last"] + role[:1] not in ("su", "ua", "au"):
                    state["illegal"] += 1
                state["last"] = role[:1]
                state["rows"].append(_KIND.get(role[:1], START) | (GONE if fault in (1, 2) else SHORT if fault == 3 else 0))
            if out:
                yield flushed()
        if state is not None:
            ended()
            yield flushed()

    # of equal rows of one turn the first isn't a duplicate
    ordered = _ordered(rows, F.col("turn").asc_nulls_first(), "role", "digest", F.col("fault") == 2)
    return ordered.select("key", "turn", "role", "fault").mapInArrow(run, f"key {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string")


def _hashed(rows: DataFrame, plans: DataFrame, kind: str) -> DataFrame:
    """``plans`` with the SHA-256 of the repaired rows, which pass one by one after the row of their plan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: tuple | None = None
        digest, audit, at, q, parts = None, "", 0, START, 0
        done: list[tuple] = []

        def put(role: str, text: str) -> None:
            nonlocal parts
            digest.update((("\n" if parts else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            parts += 1

        def inserts() -> None:
            nonlocal at, q
            while at < len(audit) and audit[at] == "I":
                q = WANTED[q]
                put(NAMES[q], "")
                at += 1

        def ended() -> None:
            inserts()
            done.append((*plan, digest.hexdigest()))

        def flushed(types: list) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, ["key", *COUNTS, "audit", "repaired_sha256"])

        types: list = []
        for b in batches:
            types = [b.column(0).type, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
            for *head, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if head[-1] is not None:  # a new conversation
                    if digest is not None:
                        ended()
                    plan, digest, audit, at, q, parts = tuple(head), hashlib.sha256(), head[-1], 0, START, 0
                    continue
                inserts()
                what = audit[at]
                at += 1
                if what == "K":
                    q = _KIND[role[:1]]
                    put(role, text)
                elif what == "R":
                    q = WANTED[q]
                    put(NAMES[q], text)
            if done:
                yield flushed(types)
        if digest is not None:
            ended()
            yield flushed(types)

    none = lambda kind: F.lit(None).cast(kind)
    heads = plans.select("key", *COUNTS, "audit", none(rows.schema["turn"].dataType).alias("turn"), *[none("string").alias(c) for c in ("role", "digest", "text")])
    both = heads.unionByName(rows, allowMissingColumns=True)
    ordered = _ordered(both, F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "digest")
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return ordered.select("key", *COUNTS, "audit", "role", "text").mapInArrow(run, f"key {kind}, {counts}, audit string, repaired_sha256 string")


def repair(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per conversation: key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are in the order of their turn (nulls first), equal turns by role and by
    the hash of the text. A null role or text counts as empty; an empty role, or
    one of another initial than s, u and a, can't stay. A null key is a
    conversation of its own. Repeated rows are duplicates of the first. An empty
    table gives no rows. Other columns are not used. A conversation is one task's
    work, of which it holds a byte, its states (four numbers) and an edit per row, and one text at a time.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).withColumn("digest", F.md5(F.encode("text", "UTF-8")))
    return _hashed(rows, _plan(with_faults(rows), kind), kind).withColumnRenamed("key", key)


def with_damage(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows damaged by crc32(``key:turn``) mod 20: 0 goes, 1 loses its text, 2 its stops, 3 comes twice, 4 becomes a user's. Nulls are written as a space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.encode(F.concat(shown(key), F.lit(":"), shown(turn)), "UTF-8")) % 20
    out = df.select(key, turn, shown(role).alias(role), shown(text).alias(text), fate.alias("__fate")).where("__fate <> 0")
    out = out.withColumns({
        role: F.when(F.col("__fate") == 4, "user").otherwise(F.col(role)),
        text: F.when(F.col("__fate") == 1, "").when(F.col("__fate") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(F.col(text)),
        "__copy": F.explode(F.when(F.col("__fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    })
    return out.drop("__fate", "__copy")
