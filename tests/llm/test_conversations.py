"""Repair of conversations: SQL, all ways through the lattice, segments, and edge cases."""

import hashlib
import itertools
import random
import re

import pytest
from oracle import compare, connect

from pavestat.llm import conversations
from pavestat.llm.queries import OP13_SQL, op13_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, cost int"
NOTHING = hashlib.sha256(b"").hexdigest()


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) by trying all edits; of
    rows that stand in order."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    faults = []
    for k, (_, role, text) in enumerate(rows):
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("b" if not last else "d" if (role, text) in [x[1:] for x in rows[:k]] else "t" if last[0] not in ".!?" else "o")
    best = None
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(e != "D" and f in "bd" for e, f in zip(edits, faults, strict=True)):
            continue
        kept = [k for k, e in enumerate(edits) if e != "D"]
        for inserted in range(0, len(kept) + 3):
            for places in itertools.combinations(range(len(kept) + inserted), inserted):
                total = len(kept) + inserted
                roles = ["s"] * (total % 2) + ["u", "a"] * (total // 2)
                if total == 1:
                    continue
                queue, legal = list(kept), True
                letters = []
                for p, want in enumerate(roles):
                    if p in places:
                        legal &= want != "s"
                        letters.append(("I", None))
                        continue
                    k = queue.pop(0)
                    legal &= want != "s" if edits[k] == "R" else rows[k][1][:1] == want
                    letters.append((edits[k], k))
                if not legal:
                    continue
                cost = 5 * inserted + sum({"K": 0, "R": 1, "D": 2}[e] + (5 if e != "D" and f == "t" else 0) for e, f in zip(edits, faults, strict=True))
                if best is not None and cost > best[0]:
                    continue
                for audit, out in woven(letters, edits):
                    if best is None or (cost, audit) < best[:2]:
                        names = {"s": "system", "u": "user", "a": "assistant"}
                        lines = [f"{rows[k][1] if e == 'K' else names[w]}:{'' if e == 'I' else rows[k][2]}" for (e, k), w in zip(out, roles, strict=True)]
                        best = (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, *best)


def woven(letters, edits):
    """Audits of these written rows: a deletion stands before or after the inserts beside it."""
    slots, row = [[]], 0
    for e, k in letters:
        if e == "I":
            slots[-1].append("I")
        else:
            slots[-1] += ["D"] * (k - row)
            slots.append([e])
            slots.append([])
            row = k + 1
    slots[-1] += ["D"] * (len(edits) - row)
    for order in itertools.product(*({"".join(p) for p in itertools.permutations(s)} for s in slots)):
        yield "".join(order), letters


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, " " if r[1] is None else r[1], " " if r[2] is None else r[2]))


def generated(seed, count, most=5):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \t", "Ok!\n", None, "é"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "u"]
    return {c: order([(rng.choice([None, *range(4)]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randrange(most + 1))]) for c in range(count)}


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    compare(op13_conversation_repair(spark, sf), connect(sf), OP13_SQL)


@pytest.mark.parametrize("segment", [256, 2])
def test_repair_equals_all_edits(spark, monkeypatch, segment):
    monkeypatch.setattr(conversations, "SEGMENT_ROWS", segment)
    given = generated(segment, 60)
    rows = [(c, *r, "x", 1) for c, found in given.items() for r in found]
    df = spark.createDataFrame(rows, SCHEMA)
    result = conversations.repair(df)
    got = {r.conv_id: tuple(r)[1:] for r in result.collect()}
    assert got == {c: plain(found) for c, found in given.items() if found}
    lines = {}
    for r in sorted(conversations.repaired_turns(df, result).collect(), key=lambda r: (r.conv_id, r.position)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == v[-1] for c, v in got.items())


@pytest.mark.parametrize("segment", [3, 7, 256])
def test_segments_do_not_change_long_conversations(monkeypatch, segment):
    rng = random.Random(9)
    rows = [(k, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b.", "torn", "", f"own {k}."])) for k in range(900)]

    def run():
        now, seen = conversations._Conversation(1), set()
        for row in rows:
            now.add(*row, row[1:] in seen)
            seen.add(row[1:])
        return now.result()

    monkeypatch.setattr(conversations, "SEGMENT_ROWS", 10_000)
    whole = run()
    monkeypatch.setattr(conversations, "SEGMENT_ROWS", segment)
    assert run() == whole


def test_edge_cases(spark, tmp_path):
    long = "word " * 200_000
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (1, 1, "user", long), (1, 2, "assistant", long + "."),
        *[(2, 5, "user", "Same.")] * 3, (3, -4, "system", "S."), (3, 2, "user", "Q?"), (3, 9, "assistant", "A."), (3, None, "user", "Q?"), (4, 0, "user", ""), (4, 3, "User", "x."),
        *[(k, t, r, f"Text {t}{e}") for k in range(100, 180) for t, r, e in [(0, "user", "."), (1, "assistant", ""), (2, "user", "?"), (4, "system", "!")]],
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair(df).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[1:])
    assert got == {c: plain(order(found)) for c, found in by.items()}
    assert conversations.repair(df.limit(0)).count() == 0
    gone = conversations.repair(df, df.turn.isNull()).where("conv_id = 1").first()
    assert tuple(gone)[1:] == (0, 0, 0, 0, 0, 0, "", NOTHING)
    df.select("conv_id", "turn", "role", "text").coalesce(1).write.parquet(str(tmp_path / "sf" / "conversations.parquet"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/sf/conversations.parquet/*.parquet')")
    compare(op13_conversation_repair(spark, str(tmp_path / "sf")), con, OP13_SQL)
