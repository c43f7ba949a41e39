import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from meshnet.llm import conversation_repair as op

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
BLANKS = " \t\n\x0b\x0c\r"
STEM = re.compile(r"(s?(ua)*u?)?")  # what a repaired sequence of initials can begin with


def cheapest(turns):
    """``(cost, audit, said)`` of ``(role, text, must_go, truncated)``: every sequence of initials is kept apart, every insert tried."""
    now = {"": (0, "", ())}

    def offer(to, key, value):
        if STEM.fullmatch(key) and (key not in to or value[:2] < to[key][:2]):
            to[key] = value

    def inserts(states):
        for _ in range(3):
            for key, (cost, audit, said) in list(states.items()):
                for role in ("user", "assistant"):
                    offer(states, key + role[0], (cost + 5, audit + "I", (*said, role + ":")))

    for role, text, must_go, truncated in turns:
        inserts(now)
        then = {}
        for key, (cost, audit, said) in now.items():
            offer(then, key, (cost + 2, audit + "D", said))
            if not must_go:
                extra = 5 if truncated else 0
                if role[:1]:
                    offer(then, key + role[:1], (cost + extra, audit + "K", (*said, f"{role}:{text}")))
                for other in ("user", "assistant"):
                    offer(then, key + other[0], (cost + 1 + extra, audit + "R", (*said, f"{other}:{text}")))
        now = then
    inserts(now)
    return min(v for k, v in now.items() if re.fullmatch("(s?(ua)+)?", k))


def brute(rows, ids, solve=cheapest):
    """The columns of each conversation of ``(conv_id, turn, role, text)``."""
    out = []
    for conv in ids:
        own = [r for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, turns, faults = set(), [], [0, 0, 0]
        for _, _, role, text in own:
            bare = text.strip(BLANKS)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            turns.append((role, text, fault in (0, 1), fault == 2))
        known = [r[1] for r in own if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, said = solve(turns)
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def some(rng, conv, n):
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", " ", "User"]
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", "So. ", "é!", "same."]
    return [(conv, rng.choice([None, i, i + 3]), rng.choice(roles), rng.choice(texts)) for i in range(n)]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("parts", [1, 5])
def test_against_every_sequence(spark, monkeypatch, parts):
    rng = random.Random(parts)
    rows = [r for conv in range(70) for r in some(rng, conv, rng.randint(1, 6))]
    # One turn of a number, so that the order within it does not matter.
    rows = list({(r[0], r[1]): r for r in rows}.values())
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(7)).withColumn("there", F.lit("clash"))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert found(op.repair(df)) == brute(rows, {r[0] for r in rows})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_hot_conversation_over_many_partitions(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        role = rng.choice(["user", "assistant"])
        text = rng.choice(["Hot line.", f"Line {i}.", f"Line {i}", f"Line {i // 7}!", ""])
        rows.append((7, i * 2, role, text))
    for conv in (1, 9):
        rows += [(conv, i, "user", f"t{i}.") for i in range(3)]
    rows += [(8, None, "user", "Same.")] * 60  # one turn, over and over
    df = spark.createDataFrame(rows, SCHEMA)
    want = found(op.repair(df.coalesce(1)))
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = op.repair(df.repartition(6), with_turns=True).cache()
        assert found(got) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for r in got.collect():
        text = "\n".join(f"{t.role}:{t.text}" for t in r.turns)
        assert hashlib.sha256(text.encode()).hexdigest() == r.repaired_sha256
        assert "".join(t.edit for t in r.turns) == r.audit.replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in r.turns))

    def beam(turns):  # sequences of initials that end alike have one future
        now = {"": (0, "", ())}
        for role, text, must_go, truncated in turns:
            then = {}
            for state, (cost, audit, said) in now.items():
                ways = [(state, 2, "D", ())]
                for to, letter in ((role[:1], "K"), ("u", "R"), ("a", "R")):
                    if not must_go and to in ("u", "a") or to == "s" and not must_go and state == "":
                        put = () if to == "s" or (state == "u") == (to == "a") else (("assistant:",) if to == "u" else ("user:",))
                        name = role if letter == "K" else {"u": "user", "a": "assistant"}[to]
                        ways.append((to, 5 * len(put) + (letter == "R") + 5 * truncated, "I" * len(put) + letter, (*put, f"{name}:{text}")))
                for to, price, letters, more in ways:
                    value = (cost + price, audit + letters, said + more)
                    if to not in then or value[:2] < then[to][:2]:
                        then[to] = value
            now = then
        end = {"": (), "a": (), "u": ("assistant:",), "s": ("user:", "assistant:")}
        return min((c + 5 * len(end[s]), a + "I" * len(end[s]), said + end[s]) for s, (c, a, said) in now.items())

    assert want == brute(rows, {1, 7, 8, 9}, beam)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '/root/testdata/{sf}/conversations.parquet'")
    assert found(op.query(spark, f"/root/testdata/{sf}")) == sorted(duckdb.sql(f"SELECT {', '.join(COLUMNS)} FROM ({op.SQL})").fetchall(), key=str)


def damaged(rows):
    """The rows after damage, and all their conversations."""
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 4:
            role = "user"
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out, {r[0] for r in rows}


def test_damage_and_cases(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, t, *r[2:]) for c in range(40) for t, r in enumerate(some(rng, c, 5))]
    rows += [(None, 0, "user", "No name."), (None, 1, None, None), (50, None, "user", None), (51, None, None, "x" * 300_000), (-3, -1, "system", "S.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit(1))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(op.query(spark, str(tmp_path))) == brute(*damaged(rows))
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(duckdb.sql(f"SELECT {', '.join(COLUMNS)} FROM ({op.SQL})").fetchall(), key=str) == brute(*damaged(rows))
    gone = [(c, t, "user", "Hi.") for c in range(60) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    none = hashlib.sha256(b"").hexdigest()
    lost = op.repair(op.damage(spark.createDataFrame(gone, SCHEMA)), there=F.col("there"))
    assert gone and found(lost) == sorted([(c, 0, 0, 0, 0, 0, 0, "", none) for c, *_ in gone], key=str)
    assert found(op.repair(spark.createDataFrame([], SCHEMA))) == []
    named = spark.createDataFrame([("x", 0, "user", "A."), ("", 0, "user", "B."), (None, 0, "user", "C.")], "conv_id string, turn int, role string, text string")
    assert {r.conv_id for r in op.repair(named).collect()} == {"x", "", None}
