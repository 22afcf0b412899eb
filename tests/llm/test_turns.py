"""Conversation repair against a search over all edits, odd rows, the whole table."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

from docloom.llm import conversations as C
from docloom.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string, cost long"


def by_search(rows):
    """rows: (turn, role, text) in order. What the contract asks for, by recursion over edits."""
    faults, seen, counts = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
    for _, role, text in rows:
        ink = re.sub(r"[\x20\x09-\x0D]", "", text)
        f = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(f)
        counts[f] += 1
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(t, state, inserts):
        options = [(0, "", ())] if t == len(rows) and state in ("", "a") else []
        if inserts < 3:
            for r in set(follow[state]) & {"u", "a"}:
                c, a, said = best(t, r, inserts + 1)
                options.append((c + 5, "I" + a, (({"u": "user", "a": "assistant"}[r], ""), *said)))
        if t < len(rows):
            _, role, text = rows[t]
            c, a, said = best(t + 1, state, 0)
            options.append((c + 2, "D" + a, said))
            if faults[t] in ("", "truncated"):
                more = 5 * (faults[t] == "truncated")
                for r in follow[state]:
                    c, a, said = best(t + 1, r, 0)
                    if role[:1] == r:
                        options.append((c + more, "K" + a, ((role, text), *said)))
                    if r != "s":
                        options.append((c + more + 1, "R" + a, (({"u": "user", "a": "assistant"}[r], text), *said)))
        return min(options) if options else (10**9, "", ())

    cost, audit, said = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())


def damage(rows):
    """(conv_id, turn, role, text) rows to {conv_id: rows in order}."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        mine = out.setdefault(conv, [])
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        mine.extend([(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1))
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for k, v in out.items()}


def in_stream(rows):
    r, seen = C.Repair(1), {}
    for turn, role, text in rows:
        ink = text.rstrip(C.BREAKS)
        first = seen.setdefault((role, text), turn)
        f = C.BLANK if not ink else C.DUPLICATE if turn != first else C.TRUNCATED if ink[-1] not in ".!?" else C.CLEAN
        r.add(turn, role, text, f)
    return r.result()[1:]


def test_layers_equal_a_search_over_all_edits(monkeypatch):
    r = random.Random(4)
    for piece in (64, 3, 1):
        monkeypatch.setattr(C, "PIECE", piece)
        for _ in range(300):
            rows = [(t + r.choice([0, 0, 1]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "\U0001f600"]), r.choice(["a.", "b", "", "c!", " ", "d?", f"{t}.", f"{t}!"])) for t in range(r.randint(0, 7))]
            rows.sort(key=lambda x: (x[0], x[1].encode(), x[2].encode()))
            assert in_stream(rows) == by_search(tuple(rows)), (piece, rows)


def test_pieces_agree_with_one_piece_on_long_conversations(monkeypatch):
    r = random.Random(5)
    rows = [(t, r.choice(["user", "assistant"]), r.choice(["ok.", "cut", f"{t}."])) for t in range(300)]
    monkeypatch.setattr(C, "PIECE", 1000)
    whole = in_stream(rows)
    monkeypatch.setattr(C, "PIECE", 17)
    assert in_stream(rows) == whole


def check_table(spark, rows):
    got = {r[0]: tuple(r)[1:] for r in C.repair(C.damaged(rows)).collect()}
    expected = damage([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows.collect()])
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k] == by_search(tuple(v)), (k, v)


def test_whole_table(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    check_table(spark, rows)
    bad = C.damaged(rows)
    repairs = C.repair(bad)
    lines = C.repaired_turns(bad, repairs).orderBy("conv_id", "place").collect()
    for r in repairs.collect():
        said = "\n".join(f"{x['role']}:{x['text']}" for x in lines if x["conv_id"] == r["conv_id"])
        assert hashlib.sha256(said.encode()).hexdigest() == r["repaired_sha256"]


def test_odd_rows(spark):
    r = random.Random(6)
    rows = [(None, None, None, None, 1), (None, 1, "user", "a.", None), (None, 1, "user", "a.", None), (1, None, "user", "x " * 40_000 + ".", 0), (1, 1 << 62, "assistant", "b", 0), (1, -(1 << 62), "system", "", 0), (2, 0, "user", "a.", 0)]
    rows += [(c, r.choice([None, t, 0]), r.choice(["user", "assistant", "system", None]), r.choice(["a.", "a.", None, "b!", f"{t}?"]), t) for c in range(3, 60) for t in range(r.randint(1, 7))]
    check_table(spark, spark.createDataFrame(rows, SCHEMA))
    assert C.repair(C.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = C.repair(C.damaged(spark.createDataFrame([(dropped, 0, "user", "a.", 0)], SCHEMA))).collect()
    assert [tuple(x) for x in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_undamaged_rows_and_one_huge_conversation(spark):
    rows = spark.range(4000).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat(id, if(id = 777, '', '.')) text", "0L cost")
    got = C.repair(C.undamaged(rows)).collect()
    assert [(x["gaps"], x["truncated"], x["cost"], len(x["audit"])) for x in got] == [(0, 1, 4, 4000)]
