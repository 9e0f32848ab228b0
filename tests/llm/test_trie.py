"""The prefix trie against brute force on random, hot and odd conversations; fingerprints as a monoid."""

import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

pytest.importorskip("cellqtl.llm")
from cellqtl.llm import trie  # noqa: E402

COLUMNS = "conv_id long, turn long, role string, text string, depth int, lo string"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    rebuilt = {}
    for c, t in own.items():
        h = crc32(str(c).encode()) % 9
        family = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(family, [])[:h] + t[h:]
    held = defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            held[tuple(t[:d])].append(c)
    children = defaultdict(list)
    for k in held:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(held, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) if children[k] else 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(held[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    return sorted(
        (
            min(held[k]), len(k), min(held[k[:-1]]) if k else None, len(held[k]), len(children[k]), leaves[k], saved[k],
            sha256(",".join(str(c) for c in sorted(held[k]) if len(rebuilt[c]) == len(k)).encode()).hexdigest(),
        )
        for k in held
    )


def found(df):
    return sorted(tuple(r)[:8] for r in trie.nodes(df).collect())


def test_random_conversations(spark):
    rng = random.Random(1)
    rows = []
    for c in [*range(60), -3, -5, 100, 103, 104, 205]:
        for j in range(rng.choice((0, 1, 3, 8, 9, 12))):
            rows.append((c, None if j == 0 and c % 7 == 0 else j, rng.choice(("user", "assistant")) if j % 5 else None, rng.choice(("a", "é", "", None, "bb")) if rng.random() < 0.4 else "same", 1, "x"))
    rows += [(None, 0, "user", "lost", 1, "x"), (300, 0, "user", "z" * 200_000, 1, "x")]
    assert found(spark.createDataFrame(rows, COLUMNS).repartition(3)) == brute([r[:4] for r in rows])
    assert found(spark.createDataFrame([], COLUMNS)) == []


def test_hot_conversation_and_copies(spark):
    """A conversation that spans all ranges, repeated rows in it, and many copies of a conversation."""
    rows = [(7, j, "user", f"t{j % 11}") for j in range(700)] + [(5, 0, "user", "same")] * 3 + [(c, j, "user", "copy") for c in range(1000, 1400) for j in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(df) == brute(rows)


def test_positions_carry_over_ranges(spark):
    rows = [(c, j, "user", f"{c} {j}") for c, n in ((1, 5), (2, 300), (3, 1)) for j in range(n)]
    got = trie.positions(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()
    refs = {(r.conv_id, r.pos): r.ref for r in got}
    assert set(refs) == {(c, j + 1) for c, j, _, _ in rows}
    x = spark.createDataFrame([(k[0], k[1], v) for k, v in refs.items()], "c long, p long, ref long").select("c", "p", *(trie.lane(F.col("ref"), 0, i).alias(f"x{i}") for i in range(trie.LANES)))
    hashes = {(r.c, r.p): r[2:] for r in x.collect()}
    for r in got:
        for i in range(trie.LANES):
            assert r[f"v{i}"] == sum(hashes[r.conv_id, j][i] * pow(trie._base(0, i), j, trie.PRIME) for j in range(1, r.pos + 1)) % trie.PRIME
        assert r.b == sum(len(f"{r.conv_id} {j}") for j in range(r.pos))


def test_collisions_are_met(spark, monkeypatch):
    """With a hash that confounds turns under the first salts, references and nodes fail their checks and a later salt is taken."""
    rows = [(c, j, "user", f"{c % 3} {j}") for c in range(20) for j in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert not trie.one_text_each(df.withColumn("ref", F.lit(1)))
    real, salts = trie.lane, []

    def lane(ref, salt, i):
        salts.append(salt)
        return F.lit(1).cast("long") if salt < 2 else real(ref, salt, i)

    monkeypatch.setattr(trie, "lane", lane)
    assert found(df) == brute(rows) and max(salts) == 2


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(tuple(r) for r in trie.op12_prefix_trie(spark, d).collect()) == brute(rows)
