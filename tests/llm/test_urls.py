"""The URL filter against a model written out in Python; rules; rows of all kinds."""

import math
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

pytest.importorskip("cellqtl.llm")
from cellqtl.llm import urls  # noqa: E402


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i, c in enumerate(rest) if c in "/?#"), default=len(rest))
    host, path = rest[:end], rest[end:]
    end = min((i for i, c in enumerate(path) if c in "?#"), default=len(path))
    return "".join(c.lower() if c.isascii() else c for c in host), path[:end]


def ruled(host, path):
    best = None
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best or (None, None)


def brute(all_urls):
    rows = [(*parts(u), *ruled(*parts(u))) for u in all_urls]
    text = lambda r: "".join("0" if c in "0123456789" else c for c in r[0] + r[1])
    texts = defaultdict(Counter)
    for r in rows:
        texts[text(r)][r[3]] += 1
    held = {t: md5(t.encode()).hexdigest()[0] in urls.HELD for t in texts}
    padded = {t: urls.BEGIN * urls.ORDER + t + urls.END for t in texts}
    grams = {t: [p[i : i + urls.ORDER + 1] for i in range(len(t) + 1)] for t, p in padded.items()}
    symbols = len({g[-1] for gs in grams.values() for g in gs})
    counts = {v: Counter() for v in ("allow", "block")}
    for v, of in counts.items():
        for t, n in texts.items():
            if not held[t]:
                for g in grams[t]:
                    for k in range(urls.ORDER + 1):
                        of[g[urls.ORDER - k :]] += n[v]
    follow = {v: defaultdict(Counter) for v in counts}
    for v, of in counts.items():
        for g, n in of.items():
            if n:
                follow[v][len(g), g[:-1]][g[-1]] += n

    def p(v, g):
        low = 1 / symbols if len(g) == 1 else p(v, g[1:])
        seen = follow[v].get((len(g), g[:-1]))
        return low if not seen else (seen[g[-1]] + len(seen) * low) / (sum(seen.values()) + len(seen))

    if not all(any(n[v] and not held[t] for t, n in texts.items()) for v in counts):
        return [(r[0], r[1], r[2], r[3] or "allow") for r in rows]
    delta = {g: round((math.log(p("allow", g)) - math.log(p("block", g))) * urls.SCALE) for gs in grams.values() for g in gs}
    score = {t: math.floor(sum(delta[g] for g in gs) / len(gs)) for t, gs in grams.items()}
    classes = defaultdict(Counter)
    for t, n in texts.items():
        if held[t] and (n["allow"] or n["block"]):
            classes[max(-urls.CLASSES, min(urls.CLASSES, score[t] // urls.WIDTH))] += n
    total = sum(classes.values(), Counter())
    cut, order = 0, sorted(classes, reverse=True)
    if total["allow"] and total["block"]:
        sums, best = Counter(), []
        for i, c in enumerate(order):
            sums += classes[c]
            below = order[i + 1] if i + 1 < len(order) else c - 1
            at = (c * urls.WIDTH + (below + 1) * urls.WIDTH) // 2
            best.append((-(sums["allow"] / total["allow"] - sums["block"] / total["block"]), abs(at), at))
        cut = min(best)[2]
    return [(r[0], r[1], r[2], r[3] or ("allow" if score[text(r)] >= cut else "block")) for r in rows]


def found(df):
    return {r.page_id: tuple(r)[1:] for r in urls.judge(df).collect()}


def test_parts_and_rules(spark):
    cases = ["http://WWW.Example.COM/en/x?y#z", "https://a.net/es/1", "a.net/es/1", "http://net/fr/", "http://xnet/fr/", "http://example.com", "x://y://z.com/", "", None, "http://a.b?c=/d", "http://É.ORG/Ä",
             "http://example.com/en/1", "http://a.www.example.com/en/", "http://m.example.com/EN/", "http://.net/es/", "HTTP://a.net#/es/", "http://a.net/es"]
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    got = {r.page_id: r for r in df.select("page_id", urls.host_of(F.col("url")).alias("h"), urls.path_of(F.col("url")).alias("p")).withColumn("r", urls.rule_of(F.col("h"), F.col("p"))).collect()}
    for i, u in enumerate(cases):
        assert (got[i].h, got[i].p) == parts(u)
        assert (tuple(got[i].r) if got[i].r else (None, None)) == ruled(*parts(u))
    assert got[2].h == "" and got[0].r.rule == "www.example.com/en/" and got[11].r.verdict == "block"


def test_query_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()
    got = {r.page_id: tuple(r)[1:] for r in urls.op11_urls(spark, "/root/testdata/sf0.01").collect()}
    want = brute([r.url for r in pages])
    assert got == {r.page_id: w for r, w in zip(pages, want, strict=True)}
    assert {w[3] for w in want if w[2] is None} == {"allow", "block"}


def test_odd_rows(spark, monkeypatch):
    cases = ["http://a.com/" + "x1" * 20_000, "http://\U0001f600.org/\U0001f600é", "http://good.org/en/12", "http://good.org/en/99", None, "", "http://bad.net/es/1", "http://bad.net/fr/2", "http://bad.net/es/x", "http://ok.com/en/1", "http://fine.com/de/1", "http://bad.net/it/3"]
    df = spark.createDataFrame([(i, u, "r", "t", 1) for i, u in enumerate(cases)] + [(3, cases[3], "r", "t", 1), (None, cases[2], "r", "t", 1)], "page_id long, url string, rule string, text string, host int")
    want = brute([*cases, cases[3], cases[2]])[: len(cases)]
    assert found(df) == {**dict(enumerate(want)), None: want[2]} and urls.judge(df).count() == len(cases) + 2
    monkeypatch.setattr(urls.scores, "__defaults__", (0,))
    assert found(df) == {**dict(enumerate(want)), None: want[2]}
    assert urls.judge(df.where("false")).count() == 0
    only = df.where("page_id in (2, 9)")  # nothing is rejected
    assert found(only)[2][3] == "allow"
