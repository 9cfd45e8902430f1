import hashlib
import itertools
import random
import re
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from talkweave.llm import queries
from talkweave.llm import structure_repair as sr

DATA = Path("/root/testdata/sf0.001")
SPACE = " \t\n\x0b\x0c\r"


def follow(state):
    return 3 if state == 2 else 2


def cheapest(rows):
    """(cost, edits) of (initial, fault) rows, one state at a time, all edits written out."""
    def with_insertions(best):
        for _ in range(3):
            for p, (c, e) in list(best.items()):
                best[follow(p)] = min(best.get(follow(p), (10**9, "")), (c + 2, e + "I"))
        return best

    best = {0: (0, "")}
    for initial, fault in rows:
        now = {}
        for p, (c, e) in with_insertions(best).items():
            ways = [(p, c + 3, e + "D")]
            late = fault == "truncated"
            if fault not in ("blank", "duplicate"):
                ways.append((follow(p), c + 2 + late, e + "R"))
                if (initial == "s" and p == 0) or (initial == "u" and p != 2) or (initial == "a" and p == 2):
                    ways.append((1 if initial == "s" else follow(p), c + late, e + "K"))
            for q, cost, edits in ways:
                now[q] = min(now.get(q, (10**9, "")), (cost, edits))
        best = now
    with_insertions(best)
    return min(best[q] for q in (0, 3) if q in best)


def brute(rows):
    """The whole contract for one conversation; rows: (turn, role, text) after damage, in order."""
    seen, marked = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        marked.append((role[:1], fault))
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit = cheapest(marked)
    state, out, at = 0, [], iter(rows)
    for edit in audit:
        row = next(at) if edit != "I" else (None, None, "")
        role = "assistant" if state == 2 else "user"
        if edit == "K":
            role = row[1]
        if edit != "D":
            out.append(f"{role}:{row[2]}")
            state = 1 if edit == "K" and role[0] == "s" else follow(state)
    count = lambda kind: sum(f == kind for _, f in marked)
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        s = lambda x: " " if x is None else str(x)
        code = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        row = (conv, turn, "user" if code == 4 else role, "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text)
        out += [row] * {0: 0, 3: 2}.get(code, 1)
    return out


def test_matrices_equal_plain_search():
    faults = {"D": "blank"} | {s: None for s in "suao"} | {s: "truncated" for s in "SUAO"}
    plain = sr.Grammar([])
    for n in range(4):
        for seq in itertools.product(sr.SYMBOLS, repeat=n):
            assert plain.repair("".join(seq)) == cheapest([(s.lower(), faults[s]) for s in seq])
    c = [chr(0x100 + k) for k in range(4)]
    ropes, r = sr.Grammar(["ua", c[0] + c[0], "Du", c[1] + c[1], "DD", "sU"]), random.Random(4)
    for _ in range(1500):
        seq = "".join(r.choice("uauauaDsUAo") for _ in range(r.randrange(60)))
        assert ropes.repair(ropes.compress(seq)) == cheapest([(s.lower(), faults[s]) for s in seq])
    seq = "ua" * 40_000 + "D" + "ua" * 40_000
    assert ropes.repair(ropes.compress(seq)) == (3, "KK" * 40_000 + "D" + "KK" * 40_000)


def test_grammar_is_made_of_frequent_pairs(spark):
    df = spark.createDataFrame([("uauauaua", 5), ("suaua", 3), ("DDDDD", 2), ("o", 9)], "seq string, weight long")
    g = sr.re_pair(df)
    assert g.rules[0] == "ua" and "DD" in g.rules and len(g.compress("uauauaua")) == 1
    assert sr.re_pair(df, most_rules=1).rules == ["ua"] and sr.re_pair(df.limit(0)).rules == []
    assert sr._independent(["ab", "bc", "aa", "cd", "ad"]) == ["ab", "cd", "ad"]


def test_query_equals_brute_force(spark):
    r = random.Random(9)
    says = ["Yes.", "no", "Why?", "", " \n", "Done!\t", None, "Yes.", "ends. ", "é", ".", "x" * 3000]
    rows = []
    for conv in [None, *range(40)]:
        turns = [None] * r.randrange(3) + [r.randrange(-3, 30) for _ in range(r.randrange(1, 14))]
        for turn in sorted(set(turns), key=lambda t: (t is not None, t or 0)):
            rows.append((conv, turn, r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), r.choice(says)))
    rows += [(90, k, "user" if k % 2 else "assistant", f"line {k % 50}.") for k in range(3000)] + [(91, 0, "user", "x")] * 7
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(1)).withColumn("n", F.lit("clash")).repartition(5)
    got = {x.id: tuple(x)[1:] for x in sr.repair_conversations(sr.damage(df)).collect()}
    per = {conv: [] for conv, *_ in rows}
    for conv, *row in damaged(rows):
        per[conv].append(tuple(row))
    assert set(got) == set(per)
    for conv, own in per.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0))
        assert got[conv] == brute(own), conv
    assert sr.repair_conversations(sr.damage(df.limit(0))).collect() == []


def test_conversations_without_rows_and_turns(spark):
    rows = [("a", 1, "user", "x.", 0), ("b", None, "user", "Hi.", 1), ("b", None, "assistant", "Yo.", 1), (None, 5, "assistant", "Lo.", 2)]
    got = {x.id: x for x in sr.repair_conversations(spark.createDataFrame(rows, "id string, turn int, role string, text string, copies long")).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(got["a"])[1:] == (0, 0, 0, 0, 0, 0, "", empty)
    assert tuple(got["b"])[1:8] == (0, 0, 0, 0, 0, 4, "IKKI")
    assert tuple(got[None])[1:8] == (0, 0, 1, 0, 1, 5, "IKD")


@pytest.mark.skipif(not DATA.exists(), reason="no shared tables")
def test_query_equals_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    want = c.execute(queries.ORACLE_SQL["op13_structure_repair"]).fetchall()
    names = [d[0] for d in c.description]
    got = [tuple(x[n] for n in names) for x in queries.op13_structure_repair(spark, str(DATA)).collect()]
    assert sorted(got) == sorted(want) and got
