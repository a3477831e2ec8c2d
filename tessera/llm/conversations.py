"""Repair of conversations: a forward Viterbi over the states of their role grammar.

A conversation's roles should read (system? (user assistant)+)?, by initials (s?(ua)+)?. Four
states tell what stands so far: nothing, a system turn, a user turn, an assistant turn. Each turn is
kept, given another role or deleted; turns may be inserted after each one. For each state a layer
holds the least (cost, audit), audit being the edits' initials in order, and closes with the inserts
that lead on from it, of which two at most can pay.

Two audits of equal cost over the same turns are never the beginning of one another, since they
would differ by inserts, which cost. So the least (cost, audit) of each state is all that later turns
need, and of two audits only their order and a few last characters: a layer is one of finitely many,
and steps are remembered. A conversation of any length costs a few bytes a turn.

Turns are dealt by conversation and sorted there, faults are flagged by a window over the same
partitions, so texts move once. One conversation is one stream, whatever its length: SHA-256 of its
repaired text can only be taken from the first byte to the last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import textkit as K

#: Costs of the edits, and of a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: A state that costs more than the least one by this never wins: two inserts lead from there to where an
#: assistant stands, which can do what any other state can, but must delete a system turn.
BEYOND = 2 * INSERT + DELETE
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
_SPACE = " \t\n\x0b\x0c\r"
_ROLE = {0: "user", 1: "user", 2: "assistant", 3: "user"}  # what a state takes next, if not a system turn
_AFTER = {0: 2, 1: 2, 2: 3, 3: 2}

State = tuple[int, int, str]  # cost above the layer's least, order of the audit, its undecided end


def damaged(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text), nulls as one space, damaged by crc32 of conv_id:turn modulo 20.

    0 drops the turn (live is false then, role and text are empty), 1 empties its text, 2 takes out
    its full stops, exclamation and question marks, 3 repeats it, 4 makes its role user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    out = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("live"), F.explode(times).alias("copy")).drop("copy")


def whole(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) as they are, nulls as one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), part("role"), part("text"), F.lit(True).alias("live"))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]


def _flagged(turns: DataFrame) -> DataFrame:
    """turns dealt by conversation and sorted, with the first fault of each (null if there is none)."""
    seen = F.row_number().over(Window.partitionBy("conv_id", "live", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    bare = F.rtrim(F.col("text"), F.lit(_SPACE))
    fault = F.when(bare == "", BLANK).when(F.col("seen") > 1, DUPLICATE).when(~F.right("bare", F.lit(1)).isin(".", "!", "?"), TRUNCATED)
    dealt = turns.repartition("conv_id").withColumn("seen", seen).withColumn("bare", bare).withColumn("fault", fault)
    return dealt.sortWithinPartitions("conv_id", *_order(), "seen").select("conv_id", "turn", "role", "text", "live", "fault")


def _ordered(found: dict[int, tuple[int, int, str]]) -> tuple[State | None, ...]:
    """The four states with costs above their least and audits told by order and undecided end."""
    least = min(c for c, _, _ in found.values())
    out: list[State | None] = [None] * 4
    order, head, before = -1, "", None
    for key, end, s in sorted((k, e, s) for s, (_, k, e) in found.items()):
        if key != before or not end.startswith(head):
            order, head, before = order + 1, end, key
        out[s] = (found[s][0] - least, order, end[len(head) :])
    return tuple(out)


def _closed(found: dict[int, tuple[int, int, str, tuple]]) -> dict[int, tuple[int, int, str, tuple]]:
    """found (state: cost, order, end, way) with the inserts that lead on."""
    for _ in range(2):
        for s, (cost, key, end, (p, edits)) in list(found.items()):
            new = (cost + INSERT, key, end + "I", (p, edits + "I"))
            if _AFTER[s] not in found or new[:3] < found[_AFTER[s]][:3]:
                found[_AFTER[s]] = new
    return found


@lru_cache(maxsize=1 << 16)
def _step(states: tuple[State | None, ...], initial: str, fault: int | None) -> tuple[tuple[State | None, ...], int, tuple]:
    """The next layer, its least cost above this one's, and for each state (state before, edits)."""
    found: dict[int, tuple[int, int, str, tuple]] = {}

    def offer(s: int, p: int, cost: int, edit: str) -> None:
        c, key, end = states[p]
        new = (c + cost, key, end + edit, (p, edit))
        if s not in found or new[:3] < found[s][:3]:
            found[s] = new

    for p in range(4):
        if states[p] is None:
            continue
        offer(p, p, DELETE, "D")
        if fault in (BLANK, DUPLICATE):
            continue
        more = CUT if fault == TRUNCATED else 0
        offer(_AFTER[p], p, REROLE + more, "R")
        if initial == _ROLE[p][0]:
            offer(_AFTER[p], p, KEEP + more, "K")
        elif initial == "s" and p == 0:
            offer(1, p, KEEP + more, "K")
    _closed(found)
    least = min(f[0] for f in found.values())
    found = {s: f for s, f in found.items() if f[0] <= least + BEYOND}
    return _ordered({s: f[:3] for s, f in found.items()}), least, tuple(found[s][3] if s in found else None for s in range(4))


def _first() -> tuple[tuple[State | None, ...], tuple]:
    found = _closed({0: (0, 0, "", (0, ""))})
    return _ordered({s: f[:3] for s, f in found.items()}), tuple(found[s][3] if s in found else None for s in range(4))


class _Conversation:
    """One conversation as its turns come by."""

    def __init__(self) -> None:
        self.states, way = _first()
        self.ways, self.cost = [way], 0
        self.hashes = [self._fed(hashlib.sha256(), 0, w[1], None, None) if w else None for w in way]
        self.counts, self.illegal, self.turns = [0, 0, 0, 0], 0, 0
        self.low = self.high = self.last = self.before = None

    @staticmethod
    def _fed(h, state: int, edits: str, role: str | None, text: str | None):
        """h fed with what the edits leave of a turn after `state`."""
        for e in edits:
            if e == "D":
                continue
            said = role if e == "K" else _ROLE[state]
            h.update(f"{'\n' if state else ''}{said}:{'' if e == 'I' else text}".encode("utf-8", "surrogatepass"))
            state = 1 if e == "K" and state == 0 and said[0] == "s" else _AFTER[state]
        return h

    def take(self, turn: int | None, role: str, text: str, fault: int | None) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.last
            self.high = self.last = turn
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.counts[fault or 0] += 1
        self.states, more, way = _step(self.states, initial if initial in ("s", "u", "a") else "", fault)
        self.cost += more
        self.hashes = [self._fed(self.hashes[w[0]].copy(), w[0], w[1], role, text) if w else None for w in way]
        self.ways.append(way)

    def result(self) -> tuple:
        s = min((s for s in (0, 3) if self.states[s]), key=lambda s: self.states[s])
        cost, sha = self.cost + self.states[s][0], self.hashes[s].hexdigest()
        edits, roles = [], []
        for way in reversed(self.ways):
            p, done = way[s]
            edits.append(done)
            roles.append((p, s, done))
            s = p
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, 2**63 - 1)
        return gaps, *self.counts[1:], self.illegal, cost, "".join(reversed(edits)), sha, "".join(_roles(*r) for r in reversed(roles))


def _roles(before: int, after: int, edits: str) -> str:
    """For each edit of a layer that leads from one state to the other, the initial of the turn's new role, - if it is deleted."""
    out, state = [], before
    for k, e in enumerate(edits):
        if e == "D":
            out.append("-")
        elif e == "K" and state == 0:  # a user turn or a system turn, whichever leads on to the last state
            state = to = 2
            for _ in edits[k + 1 :]:
                to = _AFTER[to]
            if to != after:
                state = 1
            out.append("u" if state == 2 else "s")
        else:
            out.append(_ROLE[state][0])
            state = _AFTER[state]
    return "".join(out)


_COLUMNS = ("gaps long", "blank long", "duplicate long", "truncated long", "illegal long", "cost long", "audit string", "repaired_sha256 string", "roles string")


def repaired(turns: DataFrame) -> DataFrame:
    """One row for each conv_id of turns (conv_id, turn, role, text, live; see damaged and whole).

    gaps, blank, duplicate, truncated and illegal count what was found; cost and audit are the
    cheapest repair, of equal ones that with the least audit; roles has the new role's initial for
    each letter of audit, - for a deleted turn; repaired_sha256 is that of the repaired turns as
    role:text, joined by newlines. Turns stand in the order of turn (nulls first), role, text; rows
    without conv_id are one conversation; repeated rows are duplicates. A role that begins with
    none of s, u, a can only be changed or deleted; so can an empty one. A conversation whose turns
    are all dropped has zeros and an empty audit. Very long texts and conversations are streamed.
    Further columns are not read. An empty table gives no rows.
    """
    K.small_batches(turns.sparkSession)
    ready = _flagged(turns)
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {', '.join(_COLUMNS)}"
    names = ["conv_id", *(c.split()[0] for c in _COLUMNS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def emit(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)

        now, current, done, size = None, None, [], 0
        for batch in batches:
            kinds = kinds or [batch.schema.field(0).type, *[pa.int64()] * 6, *[pa.string()] * 3]
            for conv, turn, role, text, live, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or conv != now:
                    if current is not None:
                        done.append((now, *current.result()))
                        size += len(done[-1][-3])
                    now, current = conv, _Conversation()
                if live:
                    current.take(turn, role, text, fault)
                if len(done) >= 1000 or size > 1 << 20:
                    yield emit(done)
                    done, size = [], 0
        if current is not None:
            done.append((now, *current.result()))
            yield emit(done)

    return ready.mapInArrow(run, schema)


def repaired_turns(turns: DataFrame, report: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 1), edit, role, text, for the report of the same turns.

    Deleted turns are left out, inserted ones have an empty text.
    """
    by = Window.partitionBy("conv_id")
    steps = report.select("conv_id", F.posexplode(F.arrays_zip(F.split("audit", "").alias("edit"), F.split("roles", "").alias("to"))).alias("step", "s")).select("conv_id", "step", "s.edit", "s.to").filter("edit <> ''")
    steps = steps.withColumn("n", F.sum((F.col("edit") != "I").cast("long")).over(by.orderBy("step"))).filter("edit <> 'D'")
    numbered = turns.filter("live").withColumn("n", F.row_number().over(by.orderBy(*_order())).cast("long"))
    own = steps.withColumn("turn_of", F.when(F.col("edit") != "I", F.col("n")))
    both = own.alias("e").join(numbered.alias("t"), F.expr("e.conv_id <=> t.conv_id and e.turn_of = t.n"), "left")
    role = F.when(F.col("edit") == "K", F.col("t.role")).otherwise(F.when(F.col("to") == "u", "user").otherwise("assistant"))
    place = F.row_number().over(Window.partitionBy("e.conv_id").orderBy("step"))
    return both.select(F.col("e.conv_id").alias("conv_id"), place.alias("place"), "edit", role.alias("role"), F.coalesce("t.text", F.lit("")).alias("text"))


def sql() -> str:
    """The same rows in DuckDB SQL: the damage, and the layers as a recursion over the turns."""
    after = "case s when 2 then 3 else 2 end"
    role = "case s when 2 then 'assistant' else 'user' end"
    line = lambda who, what: f"rep || case when s = 0 then '' else chr(10) end || {who} || ':' || {what}"
    insert = f"select conv, k, {after} as s, cost + {INSERT} as cost, audit || 'I' as audit, {line(role, repr(''))} as rep from"
    cut = f"case when fault = {TRUNCATED} then {CUT} else 0 end"
    return rf"""
with recursive crc as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
kinds as (select conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(key, ''), lambda c: ascii(c)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as kind from keyed, crc),
live as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
  from kinds, unnest(range(case when kind = 3 then 2 else 1 end)) c(copy) where kind > 0),
seen as (select *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare, row_number() over (partition by conv_id, role, text order by turn nulls first) as seen from live),
bare as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, seen) as k from seen),
convs as (select conv_id, row_number() over () as conv from (select distinct conv_id from conversations)),
turns as (select c.conv, k, turn, role, text, left(role, 1) as ini, case when bare = '' then {BLANK} when seen > 1 then {DUPLICATE} when right(bare, 1) not in ('.', '!', '?') then {TRUNCATED} else 0 end as fault
  from bare b join convs c on c.conv_id is not distinct from b.conv_id),
layers as (
  select conv, 0 as k, s, cost, audit, rep from convs, (values (0, 0, '', ''), (2, {INSERT}, 'I', 'user:'), (3, {2 * INSERT}, 'II', 'user:' || chr(10) || 'assistant:')) v(s, cost, audit, rep)
  union all
  select conv, k, s, best.cost, best.audit, best.rep from (
    with done as (
      select t.conv, t.k, l.s, l.cost, l.audit, l.rep, t.role, t.text, t.ini, t.fault from layers l join turns t on t.conv = l.conv and t.k = l.k + 1),
    edits as (
      select conv, k, s, cost + {DELETE} as cost, audit || 'D' as audit, rep from done
      union all select conv, k, {after}, cost + {REROLE} + {cut}, audit || 'R', {line(role, 'text')} from done where fault in (0, {TRUNCATED})
      union all select conv, k, case when ini = 's' then 1 else {after} end, cost + {KEEP} + {cut}, audit || 'K', {line('role', 'text')} from done
        where fault in (0, {TRUNCATED}) and (ini = case s when 2 then 'a' else 'u' end or (ini = 's' and s = 0))),
    once as (select * from edits union all {insert} edits),
    twice as (select * from once union all {insert} (select * from once where s = 2 and ends_with(audit, 'I')))
    select conv, k, s, min(struct_pack(cost := cost, audit := audit, rep := rep)) as best from twice group by conv, k, s)),
counts as (select conv, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (fault = {BLANK}) as blank, count(*) filter (fault = {DUPLICATE}) as duplicate, count(*) filter (fault = {TRUNCATED}) as truncated, max(k) as n from turns group by conv),
pairs as (select conv, count(*) as illegal from (select conv, ini, lag(ini) over (partition by conv order by k) as before, k from turns) where k > 1 and before || ini not in ('su', 'ua', 'au') group by conv),
ends as (select conv, min(struct_pack(cost := cost, audit := audit, rep := rep)) as best from layers l left join counts c using (conv) where l.k = coalesce(c.n, 0) and l.s in (0, 3) group by conv)
select v.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  best.cost::bigint as cost, best.audit as audit, sha256(best.rep) as repaired_sha256
from convs v join ends using (conv) left join counts using (conv) left join pairs using (conv)
"""
