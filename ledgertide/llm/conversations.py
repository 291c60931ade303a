"""Conversations repaired to turns that alternate: cheapest edits by dynamic programming over ordered prefix-free codes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.catalog import table
from ledgertide.llm.common import SPACE_CHARS, stored
from ledgertide.working import small

#: Conversations of more rows are cut in stretches of SEGMENT rows, whose solutions are put together afterwards.
LARGE, SEGMENT = 10_000, 2_000
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: Where the repaired roles stand: nothing yet, after system, after user, after assistant. The first and last may end.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {(NOTHING, "s"): SYSTEM, **{(at, "u"): USER for at in (NOTHING, SYSTEM, ASSISTANT)}, (USER, "a"): ASSISTANT}
_INSERTED = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: A row's macro edit is a run of inserts and then what happens to the row. No code begins another, and their numbers are in
#: ASCII order, so audits compare as the sequences of these numbers do. Longer runs only come back to a place already passed.
CODES = sorted("I" * k + edit for k in range(3) for edit in "DKR")
#: Inserts after the last row that lead to an end.
CLOSING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
_NEVER = 1 << 60


class Kind(NamedTuple):
    """What edits may do with a row."""

    initial: str
    must_go: bool
    truncated: bool


@lru_cache(maxsize=None)
def _moves(kind: Kind) -> list[tuple[int, int, int, int]]:
    """(to, from, code, cost) of every macro edit of a row."""
    moves = []
    for at in range(4):
        place = at
        for run in range(3):
            code = lambda edit: CODES.index("I" * run + edit)  # noqa: E731, B023
            cost = run * INSERT
            moves.append((place, at, code("D"), cost + DELETE))
            if not kind.must_go:
                cost += TRUNCATED * kind.truncated
                if (to := _NEXT.get((place, kind.initial))) is not None:
                    moves.append((to, at, code("K"), cost))
                moves += [(to, at, code("R"), cost + REROLE) for i in "ua" if (to := _NEXT.get((place, i))) is not None]
            place = _INSERTED[place]
    return moves


@lru_cache(maxsize=100_000)
def _layer(costs: tuple[int, ...], ranks: tuple[int, ...], kind: Kind) -> tuple[tuple[int, ...], tuple[int, ...], tuple[tuple[int, int] | None, ...], int]:
    """The next layer: for each place the cost above the least, the rank of its audit among the layer's, and a pointer (from, code);
    and the least cost. The audits of a layer's places are known by their ranks only: that of a place is the rank of the one it goes on
    from, then its code's number. Costs differ by a few inserts at most, so few layers exist and nearly all are remembered."""
    best: list[tuple[int, int, int, int]] = [(_NEVER, 0, 0, -1)] * 4
    for to, at, code, cost in _moves(kind):
        if costs[at] < _NEVER:
            best[to] = min(best[to], (costs[at] + cost, ranks[at], code, at))
    least = min(b[0] for b in best)
    order = {x: k for k, x in enumerate(sorted({b[1:3] for b in best if b[0] < _NEVER}))}
    return (
        tuple(b[0] - least if b[0] < _NEVER else _NEVER for b in best), tuple(order.get(b[1:3], 0) for b in best),
        tuple((b[3], b[2]) if b[0] < _NEVER else None for b in best), least,
    )


class Paths(NamedTuple):
    """The cheapest ways over a stretch of rows from one place: to each place a cost and a rank, and the pointers of each row."""

    costs: list[int]
    ranks: tuple[int, ...]
    pointers: list[tuple[tuple[int, int] | None, ...]]


def paths(kinds: Iterable[Kind], start: int = NOTHING) -> Paths:
    costs, ranks, pointers, spent = tuple(0 if at == start else _NEVER for at in range(4)), (0,) * 4, [], 0
    for kind in kinds:
        costs, ranks, to, least = _layer(costs, ranks, kind)
        spent += least
        pointers.append(to)
    return Paths([c + spent if c < _NEVER else _NEVER for c in costs], ranks, pointers)


def codes_of(found: Paths, end: int) -> list[str]:
    """The macro edits of the way to `end`, read back along the pointers."""
    out, at = [], end
    for to in reversed(found.pointers):
        at, code = to[at]
        out.append(CODES[code])
    return out[::-1]


def best_end(costs: list[int], ranks: tuple[int, ...] | list[int]) -> tuple[int, int]:
    """(place, whole cost) with the closing inserts."""
    cost, _, _, at = min((costs[at] + INSERT * len(run), ranks[at], run, at) for at, run in CLOSING.items())
    return at, cost


def rewrite(rows: list[tuple[str, str]], codes: list[str], start: int) -> tuple[list[tuple[str, str]], int]:
    """The repaired rows of a stretch, and the place after it."""
    out, at = [], start
    for (role, text), code in zip(rows, codes, strict=True):
        for edit in code:
            if edit == "D":
                continue
            # a rerole goes to the one role that may follow here, an insert as well
            to = _NEXT[at, role[:1]] if edit == "K" else _INSERTED[at]
            out.append((role if edit == "K" else ROLES[to], "" if edit == "I" else text))
            at = to
    return out, at


def close(at: int) -> list[tuple[str, str]]:
    out = []
    for _ in CLOSING[at]:
        at = _INSERTED[at]
        out.append((ROLES[at], ""))
    return out


def fault(text: str, seen: bool) -> str:
    body = text.rstrip(SPACE_CHARS)
    return "blank" if not body else "duplicate" if seen else "truncated" if body[-1] not in ".!?" else ""


def _kind(role: str, what: str) -> Kind:
    return Kind(role[:1] if role[:1] in ("s", "u", "a") else "", what in ("blank", "duplicate"), what == "truncated")


_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_RESULT = f"{_COUNTS}, audit string, repaired array<struct<role string, text string>>"


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with faults by crc32 of `conv_id:turn`: of 20 remainders 0 drops a row, 1 empties its text, 2
    takes its marks of sentence ends, 3 repeats it, 4 makes it the user's. Nulls count as one space. Dropped rows stay with null role
    and text, so that their conversations are known."""
    kind = F.crc32(F.concat(_text(F.col("conv_id")), F.lit(":"), _text(F.col("turn"))).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(_text(F.col("text")), "[.!?]", "")).otherwise(_text(F.col("text")))
    out = rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").when(kind != 0, _text(F.col("role"))).alias("role"), F.when(kind != 0, text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    )
    return out.drop("copy")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Conversations of sorted batches, each as its rows."""
    rows = (r for batch in batches for r in batch.to_pylist())
    return groupby(rows, key=lambda r: r["conv_id"])


def _gaps(turns: list[int]) -> int:
    return max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0


def repaired_one(rows: list[dict]) -> dict:
    """One conversation in order: counts of its faults, and the cheapest edits."""
    rows = [r for r in rows if r["role"] is not None]
    seen: set[tuple[str, str]] = set()
    faults = []
    for r in rows:
        faults.append(fault(r["text"], (r["role"], r["text"]) in seen))
        seen.add((r["role"], r["text"]))
    found = paths(_kind(r["role"], f) for r, f in zip(rows, faults, strict=True))
    end, cost = best_end(found.costs, found.ranks)
    codes = codes_of(found, end)
    out, at = rewrite([(r["role"], r["text"]) for r in rows], codes, NOTHING)
    first = [r["role"][:1] for r in rows]
    return {
        "gaps": _gaps([r["turn"] for r in rows if r["turn"] is not None]), **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in _LEGAL for p in zip(first, first[1:], strict=False)), "cost": cost,
        "audit": "".join(codes) + CLOSING[at], "repaired": [{"role": r, "text": t} for r, t in out + close(at)],
    }


def _batches(rows: Iterable[dict], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """df by run, which makes rows as dictionaries of batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(lambda batches: _batches(run(batches), arrow), schema)


def _whole(rows: DataFrame, id_type: str) -> DataFrame:
    """Conversations that a task holds, one by one."""
    run = lambda batches: ({"conv_id": k, **repaired_one(list(group))} for k, group in _runs(batches))
    return _mapped(rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"), run, f"conv_id {id_type}, {_RESULT}")


def _segments(rows: DataFrame, id_type: str) -> DataFrame:
    """Stretches of large conversations in order (part, seg), each with its faults and the cheapest ways from every place to every other.

    Rows are dealt out by ranges of conversation, turn, role and text, so a conversation takes many tasks. A row is a duplicate
    where its role and text have an earlier turn, or the row before is equal: equal rows are neighbours in one range.
    """
    firsts = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t"))
    later = F.struct(F.col("turn").isNotNull().alias("known"), "turn") != F.col("first")
    flagged = rows.join(firsts, same).select("conv_id", "turn", "role", "text", later.alias("later"))
    keys = ["conv_id", "turn", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        for conv, group in _runs(batches):
            before, seg, held = None, 0, []
            for r in group:
                here = (r["turn"], r["role"], r["text"])
                held.append((r, fault(r["text"], r["later"] or here == before)))
                before = here
                if len(held) >= SEGMENT:
                    yield segment(conv, part, seg, held)
                    seg, held = seg + 1, []
            if held:
                yield segment(conv, part, seg, held)

    def segment(conv, part, seg, held):
        faults, first = [f for _, f in held], [r["role"][:1] for r, _ in held]
        kinds = [_kind(r["role"], f) for r, f in held]
        ways = [paths(kinds, at) for at in range(4)]
        return {
            "conv_id": conv, "part": part, "seg": seg, "rows": [{"role": r["role"], "text": r["text"], "fault": f} for r, f in held], "turns": sorted({r["turn"] for r, _ in held if r["turn"] is not None}),
            **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")}, "illegal": sum(p not in _LEGAL for p in zip(first, first[1:], strict=False)),
            "first": first[0], "last": first[-1], "costs": [c for w in ways for c in w.costs], "ranks": [k for w in ways for k in w.ranks],
        }

    schema = f"conv_id {id_type}, part int, seg int, rows array<struct<role string, text string, fault string>>, turns array<long>, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>, ranks array<int>"
    return _mapped(flagged.repartitionByRange(*keys).sortWithinPartitions(*keys), run, schema)


def joined_segments(parts: list[dict]) -> tuple[list[tuple[int, int]], int]:
    """(from, to) of each stretch on the cheapest way through all, and its cost. Stretches are to a conversation what rows are to a
    stretch: a way goes on from the rank of the one before, then by its own rank among those from the same place."""
    costs, ranks, pointers = [0, _NEVER, _NEVER, _NEVER], [0] * 4, []
    for p in parts:
        best = [min((costs[at] + p["costs"][4 * at + to], ranks[at], p["ranks"][4 * at + to], at) for at in range(4)) for to in range(4)]
        order = {x: k for k, x in enumerate(sorted({b[1:3] for b in best if b[0] < _NEVER}))}
        costs, ranks = [min(b[0], _NEVER) for b in best], [order.get(b[1:3], 0) for b in best]
        pointers.append([b[3] for b in best])
    end, cost = best_end(costs, ranks)
    way, at = [], end
    for to in reversed(pointers):
        way.append((to[at], at))
        at = to[at]
    return way[::-1], cost


def _in_stretches(rows: DataFrame, id_type: str) -> DataFrame:
    """Conversations of any number of rows: (conv_id, part, seg) and the result of each stretch. Counts of the whole stand in the
    first stretch only, the rest have zeros; the audit and the repaired rows of the whole are those of the stretches in order."""
    kept = stored(_segments(rows.where("role IS NOT NULL"), id_type), "conversation-stretches")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv, group in _runs(batches):
            parts = list(group)
            way, cost = joined_segments(parts)
            crossed = sum((a["last"], b["first"]) not in _LEGAL for a, b in zip(parts, parts[1:], strict=False))
            for k, (p, (start, end)) in enumerate(zip(parts, way, strict=True)):
                yield {"conv_id": conv, "part": p["part"], "seg": p["seg"], "start": start, "end": end, "final": k == len(parts) - 1, "more_illegal": 0 if k else crossed, "cost": 0 if k else cost}

    light = kept.select("conv_id", "part", "seg", "first", "last", "costs", "ranks").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
    places = stored(_mapped(light, fold, f"conv_id {id_type}, part int, seg int, start int, end int, final boolean, more_illegal long, cost long"), "conversation-places")
    turns = kept.select("conv_id", F.explode("turns").alias("turn")).distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    heads = places.groupBy("conv_id").agg(F.min(F.struct("part", "seg")).alias("head"))
    gaps = heads.alias("h").join(turns.alias("t"), F.col("h.conv_id").eqNullSafe(F.col("t.conv_id")), "left").select("h.conv_id", "head", F.coalesce("gaps", F.lit(0)).alias("gaps"))
    at = (F.col("k.conv_id").eqNullSafe(F.col("p.conv_id"))) & (F.col("k.part") == F.col("p.part")) & (F.col("k.seg") == F.col("p.seg"))
    both = kept.alias("k").join(places.alias("p"), at).select("k.*", "start", "end", "final", (F.col("illegal") + F.col("more_illegal")).alias("all_illegal"), "cost")
    both = both.alias("b").join(small(gaps).alias("g"), F.col("b.conv_id").eqNullSafe(F.col("g.conv_id"))).select("b.*", F.when(F.struct("b.part", "b.seg") == F.col("head"), F.col("gaps")).otherwise(0).alias("gaps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for r in (r for batch in batches for r in batch.to_pylist()):
            codes = codes_of(paths((_kind(x["role"], x["fault"]) for x in r["rows"]), r["start"]), r["end"])
            out, at = rewrite([(x["role"], x["text"]) for x in r["rows"]], codes, r["start"])
            out += close(at) if r["final"] else []
            yield {k: r[k] for k in ("conv_id", "part", "seg", "gaps", "blank", "duplicate", "truncated", "cost")} | {
                "illegal": r["all_illegal"], "audit": "".join(codes) + (CLOSING[at] if r["final"] else ""), "repaired": [{"role": a, "text": b} for a, b in out],
            }

    return _mapped(both, run, f"conv_id {id_type}, part int, seg int, {_RESULT}")


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, part, seg, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of conversations (conv_id, turn, role, text).

    A conversation's rows are taken by turn, nulls first, then by role and text. A row's first fault counts: blank, equal
    in role and text to an earlier row, or cut off before a sentence's end. The edits are the cheapest that make the roles' initials
    `(s?(ua)+)?`, of equal cost those with the ASCII-least audit. repaired holds the rows after them.

    Conversations of up to LARGE rows are one row here. Larger ones are solved in stretches of SEGMENT rows by many tasks and are a row for
    each stretch, in the order of (part, seg): counts and costs add up, audits and repaired rows follow one another. A row with null role
    stands for no turn, only for its conversation. Null conv_id is a conversation of its own; gaps leave out null turns; a null text
    counts as a space. A role whose first letter is none of s, u and a can't be kept. Repeated rows are duplicates; texts may be of any
    length; an empty table gives an empty one, and other columns, whatever their names, have no effect.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.when(F.col("role").isNotNull(), _text(F.col("text"))).alias("text"))
    sizes = stored(rows.groupBy("conv_id").agg(F.count("role").alias("n")).where(F.col("n") > LARGE), "large-conversations")
    whole = lambda df: _whole(df, id_type).withColumns({"part": F.lit(0), "seg": F.lit(0)})
    columns = ["conv_id", "part", "seg", *[c.split()[0] for c in _COUNTS.split(", ")], "audit", "repaired"]
    if sizes.isEmpty():
        return whole(rows).select(columns)
    large, same = small(sizes).alias("l"), F.col("r.conv_id").eqNullSafe(F.col("l.conv_id"))
    few = rows.alias("r").join(large, same, "left_anti")
    many = rows.alias("r").join(large, same, "left_semi")
    return whole(few).select(columns).unionByName(_in_stretches(many, id_type).select(columns))


def digests(repaired: DataFrame) -> DataFrame:
    """repair()'s rows by conversation, with the SHA-256 of the repaired `role:text` lines instead of them.

    A stretch's lines are hashed in the order of stretches, so of a large conversation only one stretch is held at a time;
    the hash itself can't be taken in parts.
    """
    import hashlib

    id_type = repaired.schema["conv_id"].dataType.simpleString()
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    flat = repaired.select("conv_id", "part", "seg", *[c.split()[0] for c in _COUNTS.split(", ")], "audit", F.size("repaired").alias("n"), lines.alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv, group in _runs(batches):
            sums, audits, digest, begun = dict.fromkeys([c.split()[0] for c in _COUNTS.split(", ")], 0), [], hashlib.sha256(), False
            for r in group:
                sums = {k: v + r[k] for k, v in sums.items()}
                audits.append(r["audit"])
                if r["n"]:
                    digest.update(("\n" if begun else "").encode() + r["lines"].encode())
                    begun = True
            yield {"conv_id": conv, **sums, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}

    return _mapped(flat.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg"), run, f"conv_id {id_type}, {_COUNTS}, audit string, repaired_sha256 string")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage(), repaired: counts of its faults, the edits and the hash of the repaired lines. Odd rows as in repair()."""
    return digests(repair(damage(table(spark, sf_dir, "conversations"))))
