"""Conversation repair against a plain dynamic program over whole strings."""

from __future__ import annotations

import hashlib
import random
from itertools import groupby

import pytest

from sightline.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, n string, at string, piece int"
WHITE = " \t\n\x0b\x0c\r"


def _brute(rows):
    """rows of one conversation -> (gaps, blank, duplicate, truncated, illegal, cost, audit, said)"""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(WHITE)
        faults.append("b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {0: (0, "", [])}
    step = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def with_inserts(best):
        for _ in range(3):
            for q, (cost, audit, said) in list(best.items()):
                to, name = (3, "assistant") if q == 2 else (2, "user")
                new = (cost + 5, audit + "I", [*said, name + ":"])
                best[to] = min(best.get(to, new), new)
        return best

    for (_, role, text), fault in zip(rows, faults):
        best, after = with_inserts(best), {}
        for q, (cost, audit, said) in best.items():
            options = [(q, (cost + 2, audit + "D", said))]
            if fault not in ("b", "d"):
                late = 5 if fault == "t" else 0
                if q in step.get(role[:1], {}):
                    options.append((step[role[:1]][q], (cost + late, audit + "K", [*said, f"{role}:{text}"])))
                for name in ("user", "assistant"):
                    if q in step[name[0]]:
                        options.append((step[name[0]][q], (cost + late + 1, audit + "R", [*said, f"{name}:{text}"])))
            for to, new in options:
                after[to] = min(after.get(to, new), new)
        best = after
    best = with_inserts(best)
    cost, audit, said = min(best[q] for q in (0, 3) if q in best)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, said)


def _found(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(parts)
    reports, edits = cr.repair(df)
    told = {}
    for r in sorted(edits.collect(), key=lambda r: (r.at, r.step)):
        told.setdefault(r.conv_id, []).append(r)
    out = {}
    for r in reports.collect():
        of = told[r.conv_id]
        out[r.conv_id] = (*r[1:], "".join(e.edit * e.times for e in of), [f"{e.role}:{e.text}" for e in of if e.role is not None])
    return out


def _expected(rows):
    key = lambda r: (r[0] is not None, r[0] or 0)
    return {c: _brute([r[1:] for r in of]) for c, of in ((g[0], list(g[1])) for g in groupby(sorted(rows, key=key), key=lambda r: r[0]))}


def _conversation(rng, size):
    texts = ["", " \n", "Yes.", "No", "Why?  ", "So", *(f"word {i}{rng.choice(['', '.', '!'])}" for i in range(40))]
    roles = rng.choice([["user", "assistant"], ["user"], ["system", "user", "assistant", "tool", "", None], ["assistant", "unit"]])
    rows, role = [], "user"
    for t in range(size):
        role = rng.choice(roles) if rng.random() < 0.4 or len(roles) != 2 else {"user": "assistant"}.get(role, "user")
        rows.append((rng.choice([t, t, t, t + 3, None, 1]), role, rng.choice(texts)))
    return rows


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_equals_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(cr, "PIECE_BITS", bits)
    rng = random.Random(bits)
    rows = [(c if c else None, *r) for c in range(60) for r in _conversation(rng, rng.choice([1, 2, 3, 5, 8, 30]))]
    rows += rows[::9]
    assert _found(spark, rows) == _expected(rows)


def test_a_conversation_on_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(cr, "PIECE_BITS", 6)
    rows = [(7, t, "user" if t % 5 else "assistant", f"text {t // 3} {'' if t % 4 else '.'}") for t in range(1500)] + [(8, 0, "user", "Hi.")]
    rows += [(7, 3000 + t, "user", "the same.") for t in range(600)]
    assert _found(spark, rows, 6) == _expected(rows)


def test_runs_are_taken_by_powers():
    rng = random.Random(2)
    for _ in range(200):
        runs = [(rng.randrange(cr.N_SYMBOLS), rng.choice([1, 1, 2, 3, 7, 20])) for _ in range(rng.randint(1, 5))]
        single = [(s, 1) for s, n in runs for _ in range(n)]
        assert cr.runs_matrix(runs) == cr.runs_matrix(single)
        for state in cr.STATES:
            assert cr.piece_edits(runs, state, cr.AT_END, True) == cr.piece_edits(single, state, cr.AT_END, True)
    edits, _ = cr.piece_edits([(cr.GONE, 10**6), (3, 1), (5, 1)], 0, cr.AT_END, True)
    assert edits == "D" * 10**6 + "KK"


def test_odd_tables(spark):
    assert _found(spark, [(1, 0, "user", "x" * 500_000 + "?"), (1, 1, "assistant", "Yes.")])[1][:7] == (0, 0, 0, 0, 0, 0, "KK")
    reports, edits = cr.repair(spark.createDataFrame([], SCHEMA))
    assert reports.count() == edits.count() == 0
