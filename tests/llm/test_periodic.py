"""Periodic runs against brute force on random, looped and whole given texts."""

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

pytest.importorskip("cellqtl.llm")
from cellqtl.llm import periodic  # noqa: E402


def smallest_period(w):
    fail, k = [0] * len(w), 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k - 1]
        k += w[i] == w[k]
        fail[i] = k
    return len(w) - fail[-1]


def brute(w):
    found = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and smallest_period(w[i : j + q]) == q:
                found.add((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = (text or "").encode().replace(b"\t", b" ").split()
    if doc_id is not None and w and crc32(str(doc_id).encode()) % 10 == 0:
        g, n = crc32(str(doc_id).encode()) // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (
        doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
        sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest(),
    )


def found_of(documents):
    r = periodic.runs_of([np.array(d, np.int64) for d in documents])
    out = [[] for _ in documents]
    for k, *run in zip(r.part.tolist(), r.start.tolist(), r.length.tolist(), r.period.tolist(), strict=True):
        out[k].append(tuple(run))
    return out


def test_cover_and_shifts():
    assert {(a - b) % periodic.MODULUS for a in periodic.COVER for b in periodic.COVER} == set(range(periodic.MODULUS))


def test_extensions_against_brute_force():
    rng = random.Random(3)
    documents = [[rng.randrange(k) for _ in range(n)] for k, n in ((1, 200), (2, 300), (2, 17), (50, 100), (3, 1))] + [[1, 2, 3, 4, 5] * 80, list(range(70)) * 6]
    words = np.array([x for k, d in enumerate(documents) for x in (*d, -100 - k)])
    part = np.repeat(np.arange(len(documents)), [len(d) + 1 for d in documents])
    lce = periodic.Extensions(words, part)
    i, j = (np.array(x) for x in zip(*((a, b) for a in range(len(words)) for b in range(a + 1, min(a + 400, len(words)), 3) if part[a] == part[b]), strict=True))
    want = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        n = 0
        while words[a + n] == words[b + n]:
            n += 1
        want.append(n)
    assert lce.of(i, j).tolist() == want


def test_runs_against_brute_force():
    rng = random.Random(5)
    documents = [[], [0], [0] * 5, [0] * 6, [0] * 7, [0, 1] * 4, [0, 1] * 3, [0, 1] * 40 + [0], [0, 0, 1] * 50]
    for _ in range(300):
        n, k = rng.randrange(1, 120), rng.choice((1, 2, 2, 3, 10))
        d = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 3))
            d = [d[a + (i - a) % p] if a <= i < a + 5 * p else x for i, x in enumerate(d)]
        documents.append(d)
    documents.append([i % 700 for i in range(4000)])
    assert found_of(documents) == [brute(d) for d in documents]


def test_scan_odd_rows(spark):
    long = " ".join(f"w{i % 977}x{i % 4000}" for i in range(40_000))
    rows = [(1, None, 1), (2, "", 1), (3, " \t\n", 1), (4, "a " * 9, 1), (4, "a " * 9, 1), (None, "b c " * 5 + "\u00a0 \x1c", 1), (-7, "x\x0by\x0cz\rx y z x y z x y z q", 1), (8, long, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs long").repartition(1)
    key = lambda r: tuple((x is not None, x) for x in r)
    got = periodic.scan(df, loop=True).collect()
    assert [(r.doc_id, len(r.runs), r.runs_sha256, r.collapsed_sha256) for r in sorted(got, key=lambda r: key((r.doc_id,)))] == [(b[0], b[1], b[6], b[7]) for b in sorted((brute_row(d, t) for d, t, _ in rows[:-1]), key=lambda b: key(b[:1]))] + [
        (8, len(got[-1].runs), got[-1].runs_sha256, got[-1].collapsed_sha256)
    ]
    assert all(sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256 for r in got)
    assert [(r.start, r.length, r.period) for r in got[-1].runs] == [] or all(r.length >= max(6, 4 * r.period) for r in got[-1].runs)
    assert periodic.scan(df.where("false")).count() == 0


def test_query_against_brute_force(spark):
    got = {r.doc_id: tuple(r) for r in periodic.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    assert got == {d.doc_id: brute_row(d.doc_id, d.text) for d in docs}
