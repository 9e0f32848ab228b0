"""Operators against brute force, round trips and held-out accuracy; nulls, empty and repeated rows, empty tables."""

import math
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("cellqtl.llm")
from cellqtl.llm import chat, html, licenses, media, minhash, mixing, packing, sharding, topk, toxicity  # noqa: E402

DIR = "/root/testdata/sf0.001"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ODD = [(1, None, None, None, None, 7), (2, "", "en", "a", 0, 7), (3, "one two", "en", "a", 7, 7), (3, "one two", "en", "a", 7, 7), (None, "x y z", "en", None, 5, 7), (5, LONG, "en", "b", len(LONG), 7), (6, LONG, "en", "b", len(LONG), 7)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_toxicity_held_out(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    fold = {d: zlib.crc32(str(d).encode()) % 3 == 1 for d in labels}
    train = [d for d in labels if not fold[d]]
    model = toxicity.fit([docs[d] for d in train], [labels[d] for d in train])
    held = [d for d in labels if fold[d]]
    p = toxicity.Scorer(model).probabilities([docs[d] for d in held])
    y = np.array([labels[d] for d in held])
    assert (p[y == 1] >= 0.7).mean() > 0.6 and (p[y == 0] >= 0.7).mean() < 0.02
    cheap = model.margins(["moron", "clown", "thing"])
    codes = [toxicity.subsequences([w]) for w in ("moron", "clown", "thing")]
    value = dict(zip(model.codes.tolist(), model.values.tolist(), strict=True))
    for m, (c, w) in zip(cheap, codes, strict=True):
        norm = math.sqrt(sum(v**2 for v in Counter({k: sum(w[c[0] == k]) for k in set(c[0].tolist())}).values()))
        exact = sum(value.get(k, 0) * x for k, x in zip(c[0].tolist(), w.tolist(), strict=True)) / norm + model.bias
        assert math.isclose(m, exact, abs_tol=1e-9) or m < -0.7


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(2, 0, 0), (3, 1, 1), (3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score_texts(odd, toxicity.train(odd, labels)).count() == len(ODD)
    assert toxicity.reject_toxic(none, labels).count() == 0
    assert toxicity.reject_toxic(odd, labels).columns == odd.columns


def test_toxicity_trains_on_distinct_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_TOXIC", 4)
    monkeypatch.setattr(toxicity, "TRAIN_CLEAN", 6)
    monkeypatch.setattr(toxicity, "TRAIN_CHARS", 100)
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: sorted(zip(texts, labels, strict=True)))
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1][:30]
    labels = spark.createDataFrame([(d, 0, k % 2) for k, d in enumerate(ids)], "doc_id long, quality int, toxic int")
    once = [(d, f"text {d}") for d in ids]
    want = toxicity.train(spark.createDataFrame(once, "doc_id long, text string"), labels)
    assert len(want) == 10 and sum(y for _, y in want) == 4
    # every id is repeated often, some also with a text beyond the length, so each place of the sample would be taken by copies
    many = once * 20 + [(d, "x" * 101) for d in ids]
    assert toxicity.train(spark.createDataFrame(many, "doc_id long, text string"), labels) == want
    # an id with many texts comes with one of them before any other id's place is taken; where there are places left, with more
    hot = once[:1] * 5 + [(ids[0], f"other {i}") for i in range(50)] + once[1:]
    got = toxicity.train(spark.createDataFrame(hot, "doc_id long, text string"), labels)
    assert len(got) == 10 and [t for t in got if t[0] in dict(want) and t[0] != f"text {ids[0]}"] == [t for t in want if t[0] != f"text {ids[0]}"]
    monkeypatch.setattr(toxicity, "TRAIN_TOTAL", 30)
    assert sum(len(t) for t, _ in toxicity.train(spark.createDataFrame(hot, "doc_id long, text string"), labels)) <= 30
    monkeypatch.setattr(toxicity, "TRAIN_TOTAL", 1000)
    few = toxicity.train(spark.createDataFrame([(ids[0], "a"), (ids[0], "b"), (ids[0], "b"), (ids[1], "c")], "doc_id long, text string"), labels)
    assert few == [("a", 0), ("b", 0), ("c", 1)]


def test_toxicity_counts_weak_words_of_a_sentence_together(spark, monkeypatch):
    model = toxicity.Model(np.zeros(0, np.int64), np.zeros(0), 0.0, 1.0, 0.0, more=0.5)
    assert model.evidence([[0.5, 0.4, -1.0], [0.6, -2.0]]) == 0.5 + 0.5 * 0.4 and model.evidence([]) == -9.0
    scorer = toxicity.Scorer(model)
    monkeypatch.setattr(model, "chunk_margins", lambda chunks: [{"weak": 0.5, "feeble": 0.4, "strong": 0.6}.get(c, -1.0) for c in chunks])
    assert scorer.evidence(["A weak, feeble one. It is strong", "weak.\nfeeble", "none", None]).tolist() == [0.7, 0.5, -1.0, -9.0]
    p = model.probability(np.array([-2000.0, -1000.0, -9.0, 0.0, 9.0, 1000.0]))
    assert (np.diff(p) >= 0).all() and (np.diff(p[:5]) > 0).all() and 0 <= p[0] and p[-1] <= 1


def test_toxicity_kernel_equals_brute_force():
    def brute(a, b):
        def count(w):
            c, out = [1, *map(ord, w), 2], Counter()
            for i in range(len(c)):
                for j in range(i + 1, len(c)):
                    for k in range(j + 1, min(len(c), i + toxicity.SPAN + 1)):
                        out[c[i], c[j], c[k]] += toxicity.DECAY ** (k - i - 2)
            return out

        x, y = count(a), count(b)
        norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return sum(v * y[k] for k, v in x.items()) / norm

    landmarks, words = ["loser", "banana", "thing"], ["lo5ser", "losers", "banana", "xyz", "looser"]
    got = toxicity._kernel(words, *toxicity._landmark_matrix(landmarks))
    for i, w in enumerate(words):
        for j, z in enumerate(landmarks):
            assert math.isclose(got[i, j], brute(w, z), abs_tol=1e-9)


def test_spelled_out_words():
    assert "idiot" in toxicity.chunks_of("you i d i o t there") and "loser" in toxicity.words_of("l.o.s.e.r")


def test_html():
    page = '<html><head><title>T</title></head><body><nav><p>menu</p></nav><article><h1>A &amp; B</h1><p>one <b>t</b>wo<br>three<div class="ad">buy</div><p>four</article><footer>f</footer></body></html>'
    assert " ".join(t for k, t, _ in html.blocks(page) if k == "main") == "A & B one two three four"
    assert html.blocks(None) == [] and html.blocks("<p>x<!-- cut") == [("other", "x", 0)]


def test_html_gives_the_articles_of_the_pages(spark):
    class Articles(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.parts = False, []

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            self.parts += [" "] * (tag in ("p", "h1", "br"))

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            self.parts += [" "] * (tag in ("p", "h1"))

        def handle_data(self, data):
            self.parts += [data] * self.inside

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    for page in pages.collect():
        parser = Articles()
        parser.feed(page.html)
        parser.close()
        assert got[page.page_id] == " ".join("".join(parser.parts).split())


def test_html_suffixes_remove_what_pages_share(spark):
    shared = "subscribe to our great weekly letter and get all of the news first"
    own = ["alpha beta gamma", "delta epsilon zeta", "eta theta iota"]
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", f"<body><p>{shared}</p><p>{w}</p></body>") for i, w in enumerate(own)] + [(9, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got == {**dict(enumerate(own)), 9: ""}


def test_html_keeps_articles_whatever_their_class_names(spark):
    long = "a section of the article that no other page has in it"
    share = "follow us on all of the networks and share this page now"
    html_of = [
        "<article><aside data-u=http://x/><p>advert</p></aside><p>body</p></article>",
        f'<article><section class="ad-hoc methods">{long}</section><div class="related-work">two</div></article>',
        f'<main><div id="search-results">{long[::-1]}</div></main>',
        f'<article><p>one</p><div class="share-box">{share}</div></article>',
        f'<article><p>two</p><div class="share-box">{share}</div></article>',
        f'<article><p>six</p><div class="share">{share}</div></article>',
    ]
    rows = [(i, "http://h.org/x", h, "extra") for i, h in enumerate(html_of)] + [(6, "http://h.org/x", html_of[0], "extra")] * 2
    rows += [(None, "http://g.org", "<p>the very same words on two pages without an id</p>", "x")] * 2 + [(7, "http://g.org", "<article>" + LONG + "</article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.text) for r in html.extract(pages).collect()), key=repr)
    want = ["body", f"{long} two", long[::-1], "one", "two", "six"]
    assert got == sorted([*enumerate(want), (6, "body"), (6, "body"), (None, ""), (None, ""), (7, LONG)], key=repr)
    assert html.extract(pages.limit(0)).count() == 0


def test_media_query_fills_metadata_from_headers(spark, tmp_path, odd):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = media.op3_media(spark, str(tmp_path)).collect()
    want = Counter(sha256((r[1] or "").encode()).hexdigest() for r in ODD)
    assert Counter(r.digest for r in got) == want and len({(r.digest, r.shard, r.offset, r.length) for r in got}) == len(want)
    for r in got:
        assert r.width == 64 and r.height * 64 == r.payload_bytes == max(64, -(-r.n_bytes // 64) * 64)


def test_media_round_trip(odd, none):
    rows, members = media.store(odd)
    assert rows.count() == len(ODD) and members.count() == 4
    read = {bytes(r.digest): r for r in media.read_features(members).collect()}
    for _, text, *_ in ODD:
        data = (text or "").encode()
        r = read[sha256(data).digest()]
        assert r.n_bytes == len(data) and r.payload_sha256 == sha256(media.pad(data)).hexdigest() and r.tail_crc32 == zlib.crc32(media.pad(data)[-64:])
        assert media.decode_png(media.encode_png(data)) == media.pad(data)
    assert media.read_metadata(members).count() == 4 and media.store(none)[0].count() == 0


def brute_components(texts):
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").encode().lower().split()) else set() for d, t in texts.items()}
    label = {d: d for d in texts}
    postings = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            postings[x].add(d)
    for d, s in sorted(sets.items()):
        for e in {e for x in s for e in postings[x] if e > d}:
            if 100 * len(s & sets[e]) >= 85 * len(s | sets[e]):
                a, b = sorted((label[d], label[e]))
                label = {k: a if v == b else v for k, v in label.items()}
    return {d: (len(sets[d]), label[d]) for d in texts}


def test_minhash_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    base = [f"word{i}" for i in rng.integers(0, 500, 200)]
    for i in range(120):  # a large group with links and near misses
        w = list(base)
        for _ in range(int(rng.integers(0, 8))):
            w[int(rng.integers(0, 200))] = f"edit{rng.integers(0, 1000)}"
        texts[100_000 + i] = " ".join(w)
    docs = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, row int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_components(texts)


def kept_at(texts, percent):
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in texts.items() if (w := t.encode().lower().split())}
    label = {d: d for d in texts}
    for d in sorted(sets):
        for e in sorted(sets):
            if d < e and 100 * len(sets[d] & sets[e]) >= percent * len(sets[d] | sets[e]):
                a, b = sorted((label[d], label[e]))
                label = {k: a if v == b else v for k, v in label.items()}
    return {d for d, c in label.items() if d == c}


def test_pipeline_stages_keep_one_of_similar_texts_and_pack_the_rest(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    from tokenizers import Tokenizer

    assert minhash.bands(85) == minhash.BANDS < minhash.bands(80)
    rng = np.random.default_rng(9)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").limit(60).collect()}
    for g in range(8):  # copies with four changed words of 200: a Jaccard of 176 to 216, which is 0.81
        base = [f"word{i}" for i in rng.integers(0, 5000, 200)]
        for k in range(3):
            w = list(base)
            for at in (20, 60, 100, 140) if k else ():
                w[at + k] = f"edit{g}x{k}"
            texts[10_000 + 10 * g + k] = " ".join(w)
    rows = [(d, t, "en", "a", len(t), 1) for d, t in texts.items()]
    docs = spark.createDataFrame(rows, DOCS)
    spark.createDataFrame([(-1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in clean.collect()) == sorted(texts)  # no label: nothing is rejected
    kept = stages["near_dedup"](spark, clean, str(tmp_path))
    want = kept_at(texts, 80)
    assert {r.doc_id for r in kept.collect()} == want != kept_at(texts, 85)
    mixed = stages["mixing"](spark, kept, str(tmp_path))
    assert {r.doc_id for r in mixed.collect()} <= want and mixed.columns == docs.columns
    packed = stages["packing"](spark, kept, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    length = Counter()
    for r in packed:
        length[r.doc_id] += r.length
    extra = {length[d] - len(tokenizer.encode(texts[d], add_special_tokens=False).ids) for d in want if texts[d]}
    assert set(length) <= want and extra <= {0, 1}


def test_pipeline_runs_and_every_stage_decides(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(13)
    bad = ["moronic", "scumbag", "trashy"]
    known = ["".join(rng.choice(list("abcdefghiklmnoprstuwxyz"), int(rng.integers(2, 8)))) for _ in range(400)]
    said = lambda: [known[i] for i in rng.integers(0, 400, 60)]
    rows, toxic = [], {}
    for d in range(300):
        w = said()
        toxic[d] = d % 3 == 0
        if toxic[d]:
            w[int(rng.integers(0, 60))] = bad[d % 9 // 3]
        rows.append((d, " ".join(w), "en", f"s{d % 4}", None, d))
    rows += [(1000 + d, rows[d][1], "en", "s1", None, d) for d in range(0, 60)]  # exact copies
    rows += [(2, rows[2][1], "en", "other", None, 9), (2000, None, "en", None, None, 1), (2001, "", None, "s1", None, 1), (None, "no id at all here", "en", "s2", None, 1), (2002, LONG, "en", "s3", None, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 0, int(y)) for d, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, stage = [docs], None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
    clean, kept, mixed, packed = ([tuple(r) for r in df.collect()] for df in seen[1:])
    insulting = {d for d, t, *_ in rows if d is not None and t and any(b in t for b in bad)}
    assert not {r[0] for r in clean} & insulting and Counter(clean) == Counter(r for r in rows if r[0] not in insulting)
    # one row of each text with words; rows without words all stay
    want = Counter()
    for t in {r[1] for r in clean if r[1]}:
        own = [r for r in clean if r[1] == t]
        least = min((r[0] for r in own if r[0] is not None), default=None)
        want[min((r for r in own if r[0] == least), key=lambda r: repr(r[2:]))] += 1
    assert Counter(r[:3] for r in kept if r[1]) == Counter(k[:3] for k in want.elements()) and sum(not r[1] for r in kept) == 2
    taken = Counter(mixed)
    size = Counter()
    for r in kept:
        size[r[3]] += len((r[1] or "").split())
    assert set(taken) <= set(kept) and max(taken.values()) <= 3
    order = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    assert len(order) == len(size)
    assert {r[0] for r in packed} == {r[0] for r in mixed}
    per = Counter((r[0]) for r in packed if r[1] == 0)
    assert per == Counter(r[0] for r in mixed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_pipeline_of_an_empty_table(spark, tmp_path, none):
    import corpus_pipeline

    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_minhash_finds_pairs_just_above_the_threshold(spark):
    rng = np.random.default_rng(21)
    rows, pairs = [], 0
    while pairs < 300:  # changed words far apart: each takes five shingles
        words = [f"w{i}" for i in rng.integers(0, 10**6, 300)]
        other = list(words)
        for at in rng.choice(58, int(rng.integers(3, 5)), replace=False):
            other[5 * int(at) + 4] = "changed"
        a, b = (minhash.shingles(" ".join(w)) for w in (words, other))
        both = len(np.intersect1d(a, b))
        if 0.85 <= both / (len(a) + len(b) - both) < 0.91:
            rows += [(2 * pairs, " ".join(words)), (2 * pairs + 1, " ".join(other))]
            pairs += 1
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(c in (d, d - 1) for d, c in got.items())  # no link but within a pair
    assert sum(got[2 * i + 1] == 2 * i for i in range(pairs)) >= 0.99 * pairs


def test_minhash_fine_bits_keep_pairs_of_the_threshold():
    rng = np.random.default_rng(5)
    for percent in (80, 85):
        seen = []
        for _ in range(60):
            s = rng.integers(0, 2**63, 400, dtype=np.uint64)
            k = int(400 * 2 * percent / (100 + percent)) + 1
            t = np.concatenate([s[:k], rng.integers(0, 2**63, 400 - k, dtype=np.uint64)])
            differ = sum(int(x).bit_count() for x in (minhash.fine_bits(s) ^ minhash.fine_bits(t)).view(np.uint64))
            seen.append(minhash.FINE - differ >= minhash.least_fine(percent))
        assert all(seen)


def test_minhash_odd_rows(odd, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()), key=repr)
    n = len(minhash.shingles(LONG))
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (3, 1, 3, True), (None, 1, None, True), (5, n, 5, True), (6, n, 5, False)], key=repr)
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 5]


def packed_well(parts, rows):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for b in by.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= packing.CAPACITY
    assert sorted((r.doc_id or 0, r.piece, r.length, r.ids_crc32) for r in rows) == sorted((r.doc_id or 0, r.piece, r.length, r.ids_crc32) for r in parts)
    return len(by)


def test_packing_query_against_the_tokenizer(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got, bins = defaultdict(list), defaultdict(list)
    for r in packing.op5_packing(spark, DIR).collect():
        got[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(got) == set(docs)
    for d, text in docs.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(got[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert k == 0 or r.length == 2048
            at += r.length
        assert at == len(ids)
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-sum(n for b in bins.values() for _, n in b) // 2048) + 1


def test_elites_migrate_between_islands(spark):
    rng = np.random.default_rng(3)
    lengths = [sorted(rng.integers(500, 1500, 60).tolist(), reverse=True) for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(lengths)), "block int, lengths array<int>")
    best = defaultdict(dict)
    for r in packing.best_bins(df, 1).collect():
        best[r.block][r.place] = r.bin
    for k, sizes in enumerate(lengths):
        fill = Counter()
        for p, b in best[k].items():
            fill[b] += sizes[p]
        assert len(best[k]) == 60 and max(fill.values()) <= 2048
        assert len(fill) <= len(packing.best_fit(np.array(sizes), list(range(60)), []))
    sizes = np.array(lengths[0])
    rows = packing.evolve(sizes, [], 1)
    migrant = packing.evolve(sizes, [packing.grouping(sizes, packing.assignment(rows[0], 60))], 2)
    assert packing.fitness(migrant[0]) <= packing.fitness(rows[0])


def test_packing(spark, odd, none):
    public = pytest.importorskip("public_tokenizers")
    path, ranks = public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")
    parts = packing.pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), path, ranks)
    rows = packing.pack(parts).collect()
    bins = packed_well(parts.collect(), rows)
    assert bins <= 1.01 * sum(r.length for r in rows) / packing.CAPACITY + 1
    parts = packing.pieces(odd, path)
    packed_well(parts.collect(), packing.pack(parts).collect())
    assert packing.pack(packing.pieces(none, path)).count() == 0


def test_tokens_equal_the_tokenizer():
    public = pytest.importorskip("public_tokenizers")
    path, ranks = public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    texts = ["a  b", "x, y", "a\n\nb", " a", "a ", "", "<|endoftext|> x", "%%%. a", "don't, you're. a\nb", "é, ñ.\nx 12, 3.5. y", "日本, 語. x", "a\u00a0b c"]
    for r in (None, ranks):
        assert packing.encode(texts, path, r) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_sharding(spark, odd, none):
    rows = odd.select("doc_id", "text").repartition(3)
    got = sharding.assign_shards(rows, ["doc_id", "text"], 3).collect()
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and sorted(map(len, places.values())) == [2, 2, 3]
    assert sharding.assign_shards(none.select("doc_id", "text"), ["doc_id", "text"], 3).count() == 0
    m = sharding.communication_matrix(np.array([10, 0, 7, 5]), 4, 1)
    assert m.sum(1).tolist() == [10, 0, 7, 5] and set(m.sum(0)) == {5, 6}


#: Columns named like outputs and helper columns of the operators.
NAMES = "target source_size _source _rate _copies _copy copies rate size u shard slot _block _ends _at _mix _piece sequence_id offset final island round _bin _fill _place h c one_id _one_id _one_h _of _kept kept component_id digest n_shingles score predicted toxic nth hidden key low words n_words labels".split()


def test_columns_of_any_name_and_all_rows_are_kept(spark, odd, none):
    wide = odd.select("doc_id", "text", "source", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])
    values = lambda df: Counter(tuple(r) for r in df.collect())
    labels = spark.createDataFrame([(2, 0, 0)], "doc_id long, quality int, toxic int")
    assert values(toxicity.reject_toxic(wide, labels)) == values(wide)
    kept = minhash.keep_one(wide, 80)
    assert kept.columns == wide.columns and len(kept.collect()) == 5
    mixed = mixing.mix(wide)
    assert mixed.columns == wide.columns and set(values(mixed)) <= set(values(wide))
    sharded = sharding.assign_shards(wide, ["doc_id", "text"], 3)
    rest = [c for c in wide.columns if c not in ("shard", "slot")]
    assert values(sharded.select(*rest)) == values(wide.select(*rest)) and sharded.columns.count("shard") == 1
    parts = wide.withColumns({"piece": F.lit(0), "length": F.lit(700).cast("long"), "ids_crc32": F.lit(5).cast("long")})
    packed = packing.pack(parts)
    rest = [c for c in parts.columns if c not in ("sequence_id", "offset")]
    assert values(packed.select(*rest)) == values(parts.select(*rest)) and packed.columns.count("offset") == 1
    for f in (lambda d: minhash.near_duplicates(d), lambda d: licenses.scan(d), lambda d: media.store(d)[0], lambda d: packing.pieces(d, TOKENIZER)):
        assert values(f(wide).select("doc_id").distinct()) == values(wide.select("doc_id").distinct()) and f(wide.limit(0)).count() == 0


def test_sharding_query_against_the_texts(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    got = sharding.op6_sharding(spark, DIR).collect()
    data = lambda r: (r.text or "").encode()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r.doc_id, len(data(r)) + 16, zlib.crc32(data(r))) for r in docs)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, ())) for k in range(40)]
    assert set(slots) <= set(range(40)) and max(counts) - min(counts) <= 1


def test_mixing(spark, odd, none):
    assert mixing.mix(none).count() == 0 and mixing.mix(odd).columns == odd.columns
    t = {r.source: (r.source_size, r.target) for r in mixing.rates(odd.select("source", mixing.words().alias("size"))).collect()}
    total = sum(s for s, _ in t.values())
    assert math.isclose(sum(x for _, x in t.values()), total) and all(x <= 3 * s + 1e-6 for s, x in t.values())


def brute_licenses(text):
    """n_words, places, base labels, labels, score, from every window and every template."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    labels, best = set(), 0.0
    for t, label in licenses.TEMPLATES:
        size, want = 8, set(t.split())
        while size < len(t.split()):
            size *= 2
        for i in range(0, max(1, len(words) - size), size):
            share = len(want & set(words[i : i + 2 * size])) / len(want)
            if share >= 0.8 - 1e-9:
                labels.add(label)
                best = max(best, share)
    at, base = [i for i, _ in places], {x for _, x in places}
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), round(best, 9)


def test_licenses_equal_brute_force(spark, odd, none):
    rng = np.random.default_rng(11)
    texts = ["Licensed under the MIT  License.", "the gnu general public license and CC-BY", "Released under the MIT License.\nfoo", None, "", "mit license mit license", LONG + " Released under the MIT License " + LONG]
    texts += ["This work is licensed under a Creative Commons\n# Attribution 4.0 International License", "permission is hereby granted, free of\n// charge, to any person"]
    for t, _ in licenses.TEMPLATES:  # each template broken in some places, cut short, with words around it
        for k in range(1, 6):
            w = t.split()
            w = w[: len(w) - k + 1]
            for at in rng.choice(len(w) - 1, min(k, len(w) - 1), replace=False):
                w[at] += "\r\n * " if k % 2 else "\n\n--\n"
            texts.append("see " * int(rng.integers(0, 40)) + "the file of mit here\nand under " + " ".join(w) + " version or\nlicense")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told = lambda r: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))
    got = {r.doc_id: told(r) for r in licenses.scan(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_licenses(t), t
    assert "cc-by-4.0" in got[7][5] and got[2][6] == 1.0
    assert all(got[9 + 5 * i][6] == 1.0 for i in range(len(licenses.TEMPLATES)))
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(none).count() == 0
    real = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    for r in licenses.op8_licenses(spark, DIR).collect():
        assert told(r) == brute_licenses(real[r.doc_id])


def test_topk(spark):
    rng = np.random.default_rng(5)
    q, p = rng.integers(-60, 60, (40, 16)), rng.integers(-60, 60, (900, 16))
    p[500:600] = p[0]
    ids, scores = topk.dual_search(q, np.arange(40), p, np.arange(900), 5)
    for i in range(40):
        want = sorted(((-int(s), j) for j, s in enumerate(p @ q[i]) if j != i))[:5]
        assert [(-int(s), int(j)) for s, j in zip(scores[i], ids[i], strict=True)] == want
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0]), (1, [0.5, 0.5])]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id % 50 = 0"), 5).collect()] == [(0, 1, 1, 768 * 128), (0, 2, 1, 768 * 128)]


def test_topk_in_cells_equals_brute_force_and_leaves_cells_out(spark, none, monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(topk, "CELL", 100)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    middle = rng.normal(0, 4, (12, 6))
    x = np.concatenate([m + rng.normal(0, 0.05, (100, 6)) for m in middle]).round(3)
    x[200:500] = x[7]  # a very common vector
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(5000 + i, [float(i), 1.0]) for i in range(60)] + [(None, [1.0] * 6), (6000, None)]
    seen = []
    route = topk.route
    monkeypatch.setattr(topk, "route", lambda *a: seen.append(route(*a)) or seen[-1])
    v = topk.integer_vectors(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, cell string"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id % 50 = 0"), 5).collect()}
    whole = {i: np.floor(np.array(w) * 256).astype(int) for i, w in rows if i is not None and w}
    for q in (i for i in whole if i % 50 == 0):
        want = sorted((-int(whole[q] @ w), i) for i, w in whole.items() if i != q and len(w) == len(whole[q]))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in want]
    assert len(got) == 5 * sum(i % 50 == 0 for i in whole)
    assert seen[1].where("dim = 6").count() < 0.5 * seen[0].where("dim = 6").count() * 12
    empty = v.limit(0)
    assert topk.top_k(empty, empty, 5).count() == 0


def test_chat_round_trip(spark):
    said = ["a <|im_start|> b", "c:\\n \\", "<\\|x", None, "", chat.PLANTED, "\\\\<|"]
    rows = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(said)] + [(2, 0, "odd\nro\\nle<|", "x"), (2, 0, "odd\nro\\nle<|", "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.steps(df)).collect()}
    for c in (1, 2, None):
        turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha256(loss.encode()).hexdigest())
    whole = chat.examples(df).where("conv_id = 1").orderBy("example").collect()
    assert len(whole) == 3 and all(e.completion.endswith(chat.END + "\n") for e in whole)
    assert chat.steps(df.limit(0)).count() == 0


def test_chat_query_reads_whole_examples(spark, tmp_path, monkeypatch):
    turns = [("system", "s<|"), ("user", "u\\"), ("assistant", "é one"), ("user", "v"), ("assistant", "two"), ("assistant", ""), ("user", "last")]
    rows = [(1, i, role, text) for i, (role, text) in enumerate(turns)] + [(2, 0, "user", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    form = lambda part: "".join(f"<|im_start|>{role}\n{text.replace(chr(92), chr(92) * 2).replace('<|', '<' + chr(92) + '|')}<|im_end|>\n" for role, text in part)
    seen = []
    build = chat.whole
    monkeypatch.setattr(chat, "whole", lambda c: seen.append(build(c)) or seen[-1])
    got = {r.conv_id: r for r in chat.op10_chat(spark, str(tmp_path)).collect()}
    whole = {(r.conv_id, r.example): r for r in seen[0].where("conv_id > 0").collect()}
    replies = [i for i, (role, _) in enumerate(turns) if role == "assistant"]
    assert sorted(whole) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)]
    for k, i in enumerate(replies):
        r = whole[1, k]
        assert r.formatted == form(turns[: i + 1])
        assert r.formatted[r.loss_start - 1 :][: r.loss_chars] == turns[i][1] and r.formatted[r.loss_start - 1 + r.loss_chars :] == "<|im_end|>\n"
    assert whole[1, 3].formatted == form(turns) and whole[1, 3].loss_start is None and whole[2, 0].loss_start is None
    assert got[1].n_turns == 7 and got[1].formatted_chars == len(form(turns)) and got[1].loss_chars == len("é onetwo") and got[2].loss_chars == 0
    parts = chat.examples(df).where("example = 1").collect()
    assert [(p.context + p.completion, p.completion) for p in parts] == [(form(turns[:5]), "two<|im_end|>\n")]


def test_components_of_odd_links(spark):
    from cellqtl.llm.components import components

    rows = [(1, 2), (2, 1), (2, 3), (7, 7), (None, 9), (9, None), (20, 10)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.id: r.c for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 20: 10, **{i: 100 for i in range(100, 141)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_go_on_from_labels(spark):
    from cellqtl.llm.components import components

    rows = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(1, 12) if k != 7]
    links = spark.createDataFrame(rows, "a long, b long")
    some = components(links.where("a % 3 <> 1"), rounds=1)
    assert all(r.c <= r.id for r in some.collect())
    star = {r.id: r.c for r in components(links.where("a = 7"), rounds=1).collect()}
    assert star == dict.fromkeys(range(1, 12), 1)
    assert {r.id: r.c for r in components(links, some).collect()} == {**dict.fromkeys(range(1, 12), 1), **dict.fromkeys(range(100, 141), 100)}


def test_minhash_compares_no_texts_whose_own_words_keep_them_apart(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(80):  # ten words of its own each: a similarity of some 0.7 to each other
        own = set(rng.choice(300, 10, replace=False).tolist())
        texts.append(" ".join(f"own{i}x{j}" if j in own else w for j, w in enumerate(base)))
    pairs, verified = [], minhash.verified
    monkeypatch.setattr(minhash, "verified", lambda p, *more: pairs.append(p.count()) or verified(p, *more))
    monkeypatch.setattr(minhash, "least_fine", lambda percent: 0)  # all that share a table
    texts += [" ".join(base), " ".join(base[:-1])]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: c for k, (_, c) in brute_components(dict(enumerate(texts))).items()} and got[81] == 80
    assert len(pairs) == minhash.ROUNDS + 1 and pairs[0] > 0 and pairs[-1] == 0


def test_components_go_on_with_the_links_that_are_left(spark):
    from cellqtl.llm.components import components, merged

    links = spark.createDataFrame([(1, 2), (2, 3), (1, 3), *((k, k + 1) for k in range(100, 140))], "a long, b long")
    label, left = merged(links, rounds=1)
    assert 0 < left.count() < 80 and not left.where("a < 100").count()  # links inside of a label are dropped
    got = {r.id: r.c for r in components(left.union(spark.createDataFrame([(3, 140)], "a long, b long")), label).collect()}
    assert got == dict.fromkeys([1, 2, 3, *range(100, 141)], 1)


def test_nothing_else_imports_this_subpackage():
    root = Path(__file__).resolve().parents[2]
    for f in (root / "cellqtl").rglob("*.py"):
        assert f.parent.name == "llm" or not re.search(r"\bllm\b", f.read_text())
