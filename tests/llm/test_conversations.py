"""Repair of conversations against every possible repair, and against SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from tessera.llm import conversations as C

GRAMMAR = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def hurt(rows):
    """The damage, plainly: live rows of (conv, turn, role, text) by conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for mine in out.values():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def repairs(rows, found):
    """Every repair with at most two inserts in a row: (cost, audit, turns); those that cannot be finished go early."""

    def grow(k, cost, audit, turns):
        if cost > best[0]:
            return
        roles = "".join(r[:1] for r, _ in turns)
        if not any(GRAMMAR.fullmatch(roles + rest) for rest in ("", "a", "ua")):
            return
        if k == len(rows) and GRAMMAR.fullmatch(roles) and all(r[:1] for r, _ in turns):
            best[0] = min(best[0], cost)
            yield cost, audit, turns
        if not audit.endswith("II"):
            for role in ("user", "assistant"):
                yield from grow(k, cost + 5, audit + "I", [*turns, (role, "")])
        if k < len(rows):
            _, role, text = rows[k]
            if found[k] not in ("blank", "duplicate"):
                cut = 5 * (found[k] == "truncated")
                yield from grow(k + 1, cost + cut, audit + "K", [*turns, (role, text)])
                for to in ("user", "assistant"):
                    yield from grow(k + 1, cost + cut + 1, audit + "R", [*turns, (to, text)])
            yield from grow(k + 1, cost + 2, audit + "D", turns)

    best = [2 * len(rows)]  # all deleted
    return min(grow(0, 0, "", []), key=lambda r: r[:2])


def want(rows):
    out = {}
    for conv, mine in hurt(rows).items():
        found = faults(mine)
        cost, audit, turns = repairs(mine, found)
        ts = [t for t, _, _ in mine if t is not None]
        initials = [r[:1] for _, r, _ in mine]
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        out[conv] = (max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha), turns
    return out


def made(seed, n):
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        turn = 0
        for _ in range(rng.randint(1, 7)):
            turn += rng.choice([0, 1, 1, 1, 1, 2])
            role = rng.choice(["user", "assistant"] * 6 + ["system", "tool", "User", None, ""])
            text = rng.choice(["Yes.", "No", "What is it?", "It is so.", " ", "", None, "a b\n. ", "Here!\t\r", "c", "Ünd so."]) if rng.random() < 0.7 else f"text {rng.random()}."
            out.append((conv, turn if rng.random() < 0.95 else None, role, text))
    return out


def check(spark, rows):
    turns = C.damaged(spark.createDataFrame(rows, SCHEMA).repartition(3))
    report = C.repaired(turns)
    got = {r["conv_id"]: tuple(r)[1:-1] for r in report.collect()}
    expected = want(rows)
    assert got == {k: v[0] for k, v in expected.items()}
    return turns, report, expected


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_repair(spark, seed):
    turns, report, expected = check(spark, made(seed, 150))
    texts = {}
    for r in C.repaired_turns(turns, report).orderBy("conv_id", "place").collect():
        texts.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert texts == {k: v[1] for k, v in expected.items() if v[1]}
    for r in report.filter("audit <> ''").collect():
        assert len(r["roles"]) == len(r["audit"]) and GRAMMAR.fullmatch(r["roles"].replace("-", ""))


def test_sql(spark):
    """The SQL on the same rows, among them conversations without id and turns without number."""
    rows = [*made(3, 60), (None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (None, 2, "user", "So?")]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    sql = {r[0]: r[1:] for r in con.execute(C.sql()).fetchall()}
    assert sql == {k: v[0] for k, v in want(rows).items()}
    check(spark, rows)


def plain(rows, found):
    """The layers with whole strings."""
    after, says = {0: 2, 1: 2, 2: 3, 3: 2}, {0: "u", 1: "u", 2: "a", 3: "u"}
    now = {0: (0, "")}
    for k in range(len(rows) + 1):
        new = now if k == 0 else {}
        for s, (cost, audit) in now.items() if k else ():
            cut = 5 * (found[k - 1] == "truncated")
            ini = rows[k - 1][1][:1]
            ways = [(s, cost + 2, audit + "D")]
            if found[k - 1] not in ("blank", "duplicate"):
                ways.append((after[s], cost + cut + 1, audit + "R"))
                if ini == says[s] or (ini == "s" and s == 0):
                    ways.append((1 if ini == "s" else after[s], cost + cut, audit + "K"))
            for t, c, a in ways:
                new[t] = min(new.get(t, (c, a)), (c, a))
        for _ in range(2):
            for s, (c, a) in list(new.items()):
                new[after[s]] = min(new.get(after[s], (c + 5, a + "I")), (c + 5, a + "I"))
        now = new
    return min(now[s] for s in (0, 3) if s in now)


@pytest.mark.parametrize("kind", ["mixed", "user", "assistant", "system", "cut", "blank"])
def test_long_conversations(kind):
    """Layers told by order and end alone give the audit of layers with whole strings."""
    for seed in range(30):
        rng = random.Random(seed)
        roles = {"mixed": ["user", "assistant", "system", "tool"], "cut": ["user", "assistant"], "blank": ["user"]}.get(kind, [kind, kind, kind, "user"])
        rows = [(k, rng.choice(roles), f"{k}" if kind == "cut" and rng.random() < 0.7 else "" if kind == "blank" and rng.random() < 0.8 else f"{k}.") for k in range(120)]
        found = faults(rows)
        one = C._Conversation()
        for (turn, role, text), f in zip(rows, found):
            one.take(turn, role, text, {"blank": C.BLANK, "duplicate": C.DUPLICATE, "truncated": C.TRUNCATED}.get(f))
        assert one.result()[5:7] == plain(rows, found)


def test_a_conversation_of_many_turns():
    one = C._Conversation()
    for k in range(100_000):
        one.take(k, "user" if k % 7 else "assistant", f"turn {k}.", C.TRUNCATED if k % 11 == 0 else None)
    assert len(one.result()[6]) >= 100_000 and C._step.cache_info().currsize < 5000


def test_odd_rows(spark):
    wide = 2**63 - 1
    made_ = [(1, 3, "user", None, "x"), (1, 3, "user", None, "y"), (2, -wide, "user", "Long. " * 200_000, None), (2, wide, "assistant", "So.", None), (None, None, None, None, None), (4, 5, "a", "b.", "z")]
    df = spark.createDataFrame(made_, SCHEMA + ", live string")
    check(spark, [r[:4] for r in made_ if r[0] != 2])
    got = {r["conv_id"]: r for r in C.repaired(C.whole(df)).collect()}
    assert len(got) == 4 and got[2]["gaps"] == wide and got[2]["audit"] == "KK" and got[1]["blank"] == 2 and got[1]["audit"] == "DD"
    assert got[1]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert C.repaired(C.damaged(df.filter("false"))).count() == 0


def test_all_dropped(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = C.repaired(C.damaged(spark.createDataFrame([(conv, 0, "user", "x.")], SCHEMA))).first()
    assert tuple(got)[1:-1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
