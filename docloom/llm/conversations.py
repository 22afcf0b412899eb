"""Conversation structure repair by cost layers of bitsets.

A conversation is legal if its roles' initials are ``(s?(ua)+)?``. Rows are kept (0), given another role (1) or deleted
(2), empty rows are inserted (5); blank and repeated rows have to go, and a truncated row that stays adds 5. For each cost,
from 0 on, a layer holds for every turn the set of grammar states, four bits, from which the rest can be made legal for
exactly that cost. The first layer with the entry state gives the cost; tracing the bits forwards, least edit first, gives
the least audit. Rows stream through in pieces of ``PIECE``: between pieces only the four states are carried, each with its
cost, audit and running digest. That is exact: audits of one number of rows are never prefixes of each other, so the order
of two is settled before the seam.

Repeats are found by an aggregation and a join over digests of role and text. A conversation's rows have one order and one
SHA-256 over all of them, which can't be split, so they pass through one task, in a sort that spills and with a byte of
audit a row in memory; everything before that is dealt by row, whatever the sizes of conversations.

Null roles and texts count as one space; null turns come first; rows of one turn are taken by role, then text; rows without
conv_id are one conversation; an initial is the role's first character, whatever the role. Equal rows are repeats. A
conversation without rows gets zeros, an empty audit and the digest of an empty string; an empty table gives no rows. Other
columns are ignored. A gap count beyond a long stays at its largest value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose layers are held at once.
PIECE = 64
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)
RELABEL, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: States after no row, a system row, a user row, an assistant row.
START, AFTER_S, AFTER_U, AFTER_A = 1, 2, 4, 8
STATES = (START, AFTER_S, AFTER_U, AFTER_A)
#: The states from which a user, or assistant, row leads into a set.
MADE = [(START | AFTER_S | AFTER_A) * bool(b & AFTER_U) | AFTER_U * bool(b & AFTER_A) for b in range(16)]
KEPT = {
    "s": [START * bool(b & AFTER_S) for b in range(16)],
    "u": [(START | AFTER_S | AFTER_A) * bool(b & AFTER_U) for b in range(16)],
    "a": [AFTER_U * bool(b & AFTER_A) for b in range(16)],
}
NEVER = [0] * 16
#: What may follow the last row: nothing, or inserted rows.
ENDS = {0: START | AFTER_A, INSERT: AFTER_U, 2 * INSERT: AFTER_S}
OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
BREAKS = " \t\n\x0b\x0c\r"
MOST = (1 << 63) - 1


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that the checksum of conv_id and turn prescribes; dropped ones stay as rows that are not ``there``."""
    c = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), c("role").alias("role"), c("text").alias("text"),
        (F.crc32(F.concat_ws(":", c("conv_id"), c("turn")).cast("binary")) % 20).alias("code"),
    )
    code, text = F.col("code"), F.col("text")
    return rows.select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(code == 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (code != 0).alias("there"), F.explode(F.array_repeat(F.lit(0), F.when(code == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form of ``damaged``."""
    c = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), c("role").alias("role"), c("text").alias("text"), F.lit(True).alias("there"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds each row's ``fault``; of equal rows of one turn all have the first one's, so that the stream marks the others."""
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("role"), F.col("role"), F.col("text")))
    rows = rows.withColumn("key", F.when(F.col("there"), key))
    seen = rows.where("there").groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("turn").isNull()).alias("unnumbered"), F.min("turn").alias("first"))
    joined = rows.join(seen.where("n > 1").drop("n"), "key", "left")
    earlier = F.coalesce(F.col("turn").isNotNull() & (F.col("unnumbered") | (F.col("turn") > F.col("first"))), F.lit(False))
    ink = F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", "")
    fault = F.when(ink == "", BLANK).when(earlier, DUPLICATE).when(~F.substring(ink, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(CLEAN)
    return joined.select("conv_id", "turn", "role", "text", "there", fault.alias("fault"))


def layers(rows: list[tuple[str, int]], ends: dict[int, int], wanted: int) -> list[list[int]]:
    """For each cost the states at every turn from which ``ends`` is reached for exactly it, until all ``wanted`` ones are met at the first turn.

    ``rows`` are (initial, fault); ``ends`` the states after the last row, by what is still to pay there.
    """
    n, out, none = len(rows), [], [0] * (len(rows) + 1)
    at = lambda c: out[c] if c >= 0 else none
    found = 0
    while found & wanted != wanted:
        c = len(out)
        layer = [0] * (n + 1)
        layer[n] = ends.get(c, 0)
        out.append(layer)
        made, gone = at(c - INSERT), at(c - DELETE)
        for t in range(n - 1, -1, -1):
            initial, fault = rows[t]
            bits = gone[t + 1] | MADE[made[t]]
            if fault == CLEAN or fault == TRUNCATED:
                stay = c - CUT_OFF * (fault == TRUNCATED)
                bits |= KEPT.get(initial, NEVER)[at(stay)[t + 1]] | MADE[at(stay - RELABEL)[t + 1]]
            layer[t] = bits
        found |= layer[0]
    return out


def step(state: int, initial: str) -> int:
    """The state that a row of this initial leads to, 0 if none."""
    return next((s for s in STATES if KEPT.get(initial, NEVER)[s] & state), 0)


def trace(rows: list[tuple[str, int]], found: list[list[int]], state: int) -> tuple[int, str]:
    """The cost from ``state`` and its least audit, read off the layers."""
    cost = left = next(c for c, layer in enumerate(found) if layer[0] & state)
    t, n, audit = 0, len(rows), []
    bits = lambda c, t: found[c][t] if c >= 0 else 0
    while t < n or left:
        made = AFTER_A if state == AFTER_U else AFTER_U
        if t == n:
            audit.append("I")
            left -= INSERT
            state = made
            continue
        initial, fault = rows[t]
        stay = left - CUT_OFF * (fault == TRUNCATED)
        if bits(left - DELETE, t + 1) & state:
            audit.append("D")
            left, t = left - DELETE, t + 1
        elif bits(left - INSERT, t) & made:
            audit.append("I")
            left, state = left - INSERT, made
        elif fault in (CLEAN, TRUNCATED) and bits(stay, t + 1) & step(state, initial):
            audit.append("K")
            left, state, t = stay, step(state, initial), t + 1
        else:
            audit.append("R")
            left, state, t = stay - RELABEL, made, t + 1
    return cost, "".join(audit)


def applied(audit: str, rows: list[tuple[str, str]], state: int) -> list[tuple[str, str]]:
    """The (role, text) rows that an audit leaves of ``rows``, entered in ``state``."""
    out, t = [], 0
    for edit in audit:
        role, text = rows[t] if edit != "I" else ("", "")
        t += edit != "I"
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == AFTER_U else "user"
        out.append((role, text))
        state = step(state, role[:1])
    return out


class Repair:
    """One conversation as its rows come by."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.counts, self.illegal = conv_id, [0, 0, 0, 0], 0
        self.lowest = self.highest = None
        self.turns = 0
        self.previous: tuple | None = None
        self.rows: list[tuple[str, int]] = []
        self.said: list[tuple[str, str]] = []
        #: by state: cost, rank of the audit among the states', (parts before, part), digest, whether something was said
        self.paths = {START: (0, 0, None, hashlib.sha256(), False)}

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if len(self.rows) == PIECE:
            self._flush()
        row = (turn, role, text)
        if row == self.previous and fault != BLANK:
            fault = DUPLICATE
        if turn is not None and (self.highest is None or turn != self.highest):
            self.lowest = turn if self.lowest is None else self.lowest
            self.highest, self.turns = turn, self.turns + 1
        if self.previous is not None and self.previous[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.previous = row
        self.counts[fault] += 1
        self.rows.append((role[:1], fault))
        self.said.append((role, text))

    def _on(self, state: int, part: tuple[int, str]) -> tuple:
        """The key by which the way through ``state`` and then ``part`` is chosen."""
        return self.paths[state][0] + part[0], self.paths[state][1], part[1]

    def _extended(self, state: int, part: str) -> tuple:
        _, _, parts, digest, begun = self.paths[state]
        lines = applied(part, self.said, state)
        digest = digest.copy()
        if lines:
            digest.update(("\n" * begun + "\n".join(f"{r}:{t}" for r, t in lines)).encode())
        return (parts, part), digest, begun or bool(lines)

    def _flush(self) -> None:
        """Carries the four states over the rows held."""
        best = {}
        kept_s = any(i == "s" and f in (CLEAN, TRUNCATED) for i, f in self.rows)
        for target in STATES:
            wanted = {START: START, AFTER_S: AFTER_S | START * kept_s}.get(target, 15) & sum(self.paths)
            if wanted:
                found = layers(self.rows, {0: target}, wanted)
                best[target] = min((*self._on(s, trace(self.rows, found, s)), s) for s in self.paths if s & wanted)
        ranks = {key: n for n, key in enumerate(sorted((rank, part) for _, rank, part, _ in best.values()))}
        self.paths = {target: (cost, ranks[rank, part], *self._extended(s, part)) for target, (cost, rank, part, s) in best.items()}
        self.rows, self.said = [], []

    def result(self) -> tuple:
        found = layers(self.rows, ENDS, sum(self.paths))
        cost, _, part, state = min((*self._on(s, trace(self.rows, found, s)), s) for s in self.paths)
        parts, digest, _ = self._extended(state, part)
        audit = []
        while parts is not None:
            parts, part = parts
            audit.append(part)
        gaps = 0 if self.highest is None else min(self.highest - self.lowest + 1 - self.turns, MOST)
        return (self.conv_id, gaps, *self.counts[1:], self.illegal, cost, "".join(reversed(audit)), digest.hexdigest())


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in OUT.split(", ")]
    kinds = [pa.string() if f.endswith("string") else pa.int64() for f in OUT.split(", ")]
    now: Repair | None = None
    for b in batches:
        done = []
        for conv_id, turn, role, text, there, fault in zip(*(c.to_pylist() for c in b.columns)):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.result())
                now = Repair(conv_id)
            if there:
                now.add(turn, role, text, fault)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(now.result(), kinds)], names)


def _in_order(rows: DataFrame, *lead: str) -> DataFrame:
    """Each conversation's rows in one task, in their order."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *lead, F.asc_nulls_first("turn"), "role", "text")


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cost, least audit and digest of every conversation of ``damaged`` or ``undamaged`` rows."""
    return _in_order(with_faults(rows)).mapInArrow(_streamed, OUT)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    audit, at, place, state = "", 0, 0, START
    for b in batches:
        out = []

        def inserted() -> None:
            nonlocal at, place, state
            while audit[at : at + 1] == "I":
                said = applied("I", [], state)[0]
                out.append((conv_id, place, "I", *said))
                at, place, state = at + 1, place + 1, step(state, said[0][:1])

        for conv_id, turn, role, text, whole in zip(*(c.to_pylist() for c in b.columns)):
            if whole is not None:
                audit, at, place, state = whole, 0, 0, START
            else:
                edit = audit[at]
                at += 1
                for said in applied(edit, [(role, text)], state):
                    out.append((conv_id, place, edit, *said))
                    place, state = place + 1, step(state, said[0][:1])
            inserted()
        columns = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["conv_id", "place", "edit", "role", "text"])


def repaired_turns(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired conversations' rows, conv_id, place from 0 on, edit, role and text, by the audits of ``repair(rows)``."""
    heads = repairs.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")
    lines = rows.where("there").select("conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("audit"))
    both = heads.unionByName(lines).withColumn("line", F.col("audit").isNull())
    return _in_order(both, "line").drop("line").mapInArrow(_turns, "conv_id long, place long, edit string, role string, text string")
