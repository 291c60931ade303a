"""Conversation repair against an enumeration of all edits, and the whole table against plain Python."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from ledgertide.llm import conversations as C

LEGAL = re.compile(r"(s?(ua)+)?")
SPACE = "\x20\t\n\x0b\x0c\r"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def enumerated(rows):
    """(cost, audit, lines) by trying every edit of every row, and up to two inserts anywhere."""
    runs = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    best = None
    choices = []
    for (role, text), fault in zip(rows, faults_of(rows), strict=True):
        more = 5 * (fault == "truncated")
        own = [(2, "D", None)]
        if fault not in ("blank", "duplicate"):
            own += [(more, "K", (role, text))] + [(more + 1, "R", (r, text)) for r in ("user", "assistant")]
        choices.append(own)
    for edits in product(*choices):
        for gaps in product(runs, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for gap, edit in zip(gaps, [*edits, None], strict=True):
                out += [("user" if g == "u" else "assistant", "") for g in gap]
                cost += 5 * len(gap)
                audit += "I" * len(gap)
                if edit:
                    cost += edit[0]
                    audit += edit[1]
                    out += [edit[2]] if edit[2] else []
            if LEGAL.fullmatch("".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def by_strings(rows):
    """(cost, audit, lines) with whole audits as strings, one edit at a time."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def grown(states):
        todo = dict(states)
        for _ in range(3):
            for at, (cost, audit, out) in list(todo.items()):
                for i, role in (("u", "user"), ("a", "assistant")):
                    to = step.get((at, i))
                    new = (cost + 5, audit + "I", [*out, (role, "")])
                    if to is not None and (to not in todo or new[:2] < todo[to][:2]):
                        todo[to] = new
        return todo

    # of two ways to a place the cheaper one, then the lesser audit, may not be the better beginning where one audit begins another,
    # so ways before and after inserts are kept apart
    states = {"": (0, "", [])}
    for (role, text), fault in zip(rows, faults_of(rows), strict=True):
        more, new = 5 * (fault == "truncated"), {}
        for at, (cost, audit, out) in [*grown(states).items(), *states.items()]:
            options = [(at, 2, "D", None)]
            if fault not in ("blank", "duplicate"):
                options.append((step.get((at, role[:1])), more, "K", role))
                options += [(step.get((at, r[0])), more + 1, "R", r) for r in ("user", "assistant")]
            for to, c, edit, r in options:
                way = (cost + c, audit + edit, [*out, (r, text)] if r is not None else out)
                if to is not None and (to not in new or way[:2] < new[to][:2]):
                    new[to] = way
        states = new
    return min((w for at, w in [*grown(states).items(), *states.items()] if at in ("", "a")), key=lambda w: w[:2])


def random_rows(rng, n):
    roles = ["user", "assistant", "system", "tool", "u", ""]
    return [(rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(["a.", "b!", "cut", "", " ", "c?"])) for _ in range(n)]


def test_dynamic_programming_against_all_edits():
    rng = random.Random(5)
    for n in [0, 1, 1, 2, 2, 2, *[3] * 25]:
        rows = random_rows(rng, n)
        got = C.repaired_one([{"turn": k, "role": r, "text": t} for k, (r, t) in enumerate(rows)])
        cost, audit, out = enumerated(rows)
        assert (got["cost"], got["audit"], [(x["role"], x["text"]) for x in got["repaired"]]) == (cost, audit, out), rows
        assert by_strings(rows) == (cost, audit, out)


def test_dynamic_programming_against_strings():
    rng = random.Random(6)
    for _ in range(300):
        rows = random_rows(rng, rng.randrange(4, 14))
        got = C.repaired_one([{"turn": k, "role": r, "text": t} for k, (r, t) in enumerate(rows)])
        assert (got["cost"], got["audit"], [(x["role"], x["text"]) for x in got["repaired"]]) == by_strings(rows), rows


def plain(rows):
    """conv_id -> result, of raw rows; nulls as None."""
    convs = {}
    for r in rows:
        conv = convs.setdefault(r["conv_id"], [])
        shown = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{shown(r['conv_id'])}:{shown(r['turn'])}".encode()) % 20
        role, text = shown(r["role"]), shown(r["text"])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        conv += [(r["turn"], "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv_id, conv in convs.items():
        conv.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        turns = {t for t, _, _ in conv if t is not None}
        pairs = [(r, t) for _, r, t in conv]
        faults = faults_of(pairs)
        cost, audit, lines = by_strings(pairs) if pairs else (0, "", [])
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(pairs, pairs[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv_id] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)
    return out


def found(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


def test_op13_against_plain_python(spark, sf):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert found(C.op13_conversation_repair(spark, sf)) == plain(rows)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(7)
    rows = [(c, t, r, x) for c in (1, 2, None) for t in (*range(9), None, None) for r, x in random_rows(rng, 1)]
    rows += [(3, None, None, None), (4, 10, "user", "same."), (4, 10, "user", "same."), (4, 11, "user", "same."), (5, 1, "assistant", "word " * 50_000)]
    return spark.createDataFrame([(*r, "x", 0, None) for r in rows], "conv_id long, turn long, role string, text string, part string, seg int, audit string")


@pytest.mark.parametrize(("large", "segment"), [(10_000, 2_000), (3, 2), (0, 1), (4, 3)])
def test_odd_rows_whole_and_in_stretches(spark, odd, monkeypatch, large, segment):
    monkeypatch.setattr(C, "LARGE", large)
    monkeypatch.setattr(C, "SEGMENT", segment)
    assert found(C.digests(C.repair(C.damage(odd)))) == plain([r.asDict() for r in odd.collect()])


def test_no_conversations(spark, odd):
    none = C.repair(C.damage(odd.limit(0)))
    assert none.count() == 0 and C.digests(none).count() == 0
