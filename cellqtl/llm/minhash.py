"""Near-duplicate documents by MinHash with tensored banding, links verified on full shingle sets.

Two small collections of ``BANDS`` hashes each (more at a lower threshold; a hash combines ``ROWS`` minhashes) give BANDS * BANDS table keys, one for each
pair of a hash of the first and one of the second, so the number of minhashes is about the square root of what as many
separate tables would take. Two documents are candidates when any table holds both. At the similarity of 0.85 that is
0.997 of pairs, at 0.9 all but one in 10,000.

Documents with equal shingle sets are one class and compared once. Candidates are met in rounds: in each table whose
classes are not yet of one component, every class is compared with one hub of the table, so large groups of copies join in
linear work. After ``ROUNDS`` rounds the classes that share a table and are still apart are compared with each other, but for those
that have too few shingles in common with all classes of other components together. Before a pair is verified, ``PLANES`` bits of each of the same minhashes tell whether its similarity can reach the threshold (four and a
half standard deviations below are let through); classes that are still apart after the rounds, few in all, get ``FINE`` more bits for that. Every link is confirmed on whole sets, which are joined to the pairs by rows.

Defined cases: null text, empty text and text without words have no shingles and are linked with nothing; documents with
fewer than five words have one shingle, the whole sequence; equal rows are of one class; a null doc_id counts as larger than
any other and is its own component where no other id is reachable; an empty table gives an empty result; extra columns
are ignored by :func:`near_duplicates` and kept by :func:`keep_one`, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components, merged
from .shared import fresh, save, slices, table

SHINGLE = 5
#: Links: 100 * intersection >= percent * union; this is op4's percent.
PERCENT = 85
ROWS, BANDS = 6, 14
#: Bits of a minhash that the check before verification looks at, and rounds of hubs.
PLANES, ROUNDS, FINE = 4, 3, 1024


def bands(percent: int) -> int:
    """Hashes of a collection with which a pair at the threshold is found as probably as BANDS find one at PERCENT."""
    missed = BANDS * math.log(1 - (PERCENT / 100) ** ROWS)
    return math.ceil(missed / math.log(1 - (percent / 100) ** ROWS) - 1e-9)


def least_agree(percent: int) -> float:
    """Agreeing minhashes from which a pair is verified: what the threshold gives less 4.5 standard deviations."""
    t, n = percent / 100, 2 * ROWS * bands(percent)
    p = t + (1 - t) / 2**PLANES
    return n * p - 4.5 * (n * p * (1 - p)) ** 0.5


_U = np.uint64
_M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
#: Odd multipliers, each a permutation of the 32-bit numbers.
_A = np.random.default_rng(1234567).integers(0, 2**31, 1024 + FINE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _M1
    x = (x ^ (x >> _U(29))) * _M2
    return x ^ (x >> _U(32))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's 5-word shingles."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change and only ASCII white space splits
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join(words) + b"\0")], np.uint64)
    acc = h[: n - SHINGLE + 1].copy()
    for k in range(1, SHINGLE):
        acc = _mix(acc) + h[k : n - SHINGLE + 1 + k]
    return np.unique(_mix(acc))


def signature(s: np.ndarray, n: int = BANDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First collection, second collection (n hashes each) and PLANES bits of each minhash, plane after plane."""
    count = 2 * ROWS * n
    x = (s >> _U(32)).astype(np.uint32)
    mins = np.full(count, ~np.uint32(0))
    for k in range(0, len(x), 4096):
        mins = np.minimum(mins, np.multiply.outer(_A[:count], x[k : k + 4096]).min(1))
    m = _mix(mins.astype(np.uint64) + _U(1))
    banded = m.reshape(2 * n, ROWS)
    acc = np.arange(2 * n, dtype=np.uint64)
    for k in range(ROWS):
        acc = _mix(acc ^ banded[:, k]) + _U(k)
    bits = np.zeros((PLANES, -(-count // 64) * 64), np.uint8)
    for k in range(PLANES):
        bits[k, :count] = (m >> _U(k)) & _U(1)
    return acc[:n].view(np.int64), acc[n:].view(np.int64), np.packbits(bits, axis=1).view("<i8").ravel()


def fine_bits(s: np.ndarray) -> np.ndarray:
    """One bit of each of FINE further minhashes."""
    x = (s.view(np.uint64) >> _U(32)).astype(np.uint32)
    mins = np.full(FINE, ~np.uint32(0))
    for k in range(0, len(x), 512):
        mins = np.minimum(mins, np.multiply.outer(_A[1024:], x[k : k + 512]).min(1))
    return np.packbits((_mix(mins.astype(np.uint64) + _U(1)) & _U(1)).astype(np.uint8)).view("<i8")


def least_fine(percent: int) -> float:
    """Agreeing bits from which a pair is verified: what the threshold gives less 4.5 standard deviations."""
    p = (1 + percent / 100) / 2
    return FINE * p - 4.5 * (FINE * p * (1 - p)) ** 0.5


def fine(sets: DataFrame) -> DataFrame:
    """id, fine."""

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([fine_bits(np.array(x, np.int64)) for x in b.column(1).to_pylist()])], ["id", "fine"])

    return sets.select("id", "shingles").mapInArrow(run, "id long, fine array<long>")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]).view(np.int64)))


def signatures(docs: DataFrame, n: int = BANDS) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, digest, a, b, bits."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    none = (np.zeros(0, np.int64),) * 3

    def run(batches):
        for b in slices(batches):
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            signed = [signature(s, n) if len(s) else none for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), *(_lists([x[j] for x in signed]) for j in range(3))],
                ["doc_id", "h", "n_shingles", "digest", "a", "b", "bits"],
            )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    return rows.mapInArrow(run, f"doc_id {kind}, h long, n_shingles long, digest binary, a array<long>, b array<long>, bits array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """digest, shingles (64-bit hashes)."""

    def run(batches):
        for b in slices(batches):
            sets = [shingles(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), _lists(sets)], ["digest", "shingles"])

    return docs.select("text").mapInArrow(run, "digest binary, shingles array<long>")


def _agree(p: str, q: str, n: int) -> Column:
    """Number of minhashes equal in all their planes; what fills up the last word is equal, so n less those that differ."""
    words = -(-2 * ROWS * n // 64)
    differ = [" | ".join(f"({p}[{k * words + i}] ^ {q}[{k * words + i}])" for k in range(PLANES)) for i in range(words)]
    return F.expr(f"{2 * ROWS * n} - (" + " + ".join(f"bit_count({d})" for d in differ) + ")")


def verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs x, y (ids) whose sets meet the threshold. Numbers of shingles and planes rule pairs out before sets are
    joined; a task holds the two sets of one pair at a time."""
    side = lambda of, c, *more: of.select(F.col("id").alias(c), *(F.col(m).alias(f"{m}_{c}") for m in more))
    seen = pairs.join(side(classes, "x", "n_shingles", "bits"), "x").join(side(classes, "y", "n_shingles", "bits"), "y")
    sized = 100 * F.least("n_shingles_x", "n_shingles_y") >= percent * F.greatest("n_shingles_x", "n_shingles_y")
    may = save(seen.where(sized & (_agree("bits_x", "bits_y", bands(percent)) >= least_agree(percent))).select("x", "y"), "candidates")
    full = may.join(side(sets, "x", "shingles"), "x").join(side(sets, "y", "shingles"), "y")
    both = full.select("x", "y", F.size(F.array_intersect("shingles_x", "shingles_y")).cast("long").alias("both"), (F.size("shingles_x") + F.size("shingles_y")).alias("sum"))
    return both.where(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select(F.col("x").alias("a"), F.col("y").alias("b"))


def tables(classes: DataFrame) -> DataFrame:
    """id, key: the tables of each class that another may share."""
    hashes = F.concat(
        F.transform("a", lambda v, i: F.struct(F.lit(0).alias("side"), i.alias("band"), v.alias("v"))),
        F.transform("b", lambda v, i: F.struct(F.lit(1).alias("side"), i.alias("band"), v.alias("v"))),
    )
    # a hash that one class alone has cannot be part of a shared table key
    single = classes.select("id", F.explode(hashes).alias("h")).select("id", F.xxhash64("h.side", "h.band", "h.v").alias("v"), "h.side")
    shared = single.groupBy("v").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("v")
    held = single.join(shared, "v", "left_semi").groupBy("id").agg(
        F.collect_list(F.when(F.col("side") == 0, F.col("v"))).alias("p"), F.collect_list(F.when(F.col("side") == 1, F.col("v"))).alias("q")
    )
    keys = held.where("size(p) > 0 and size(q) > 0").select("id", F.explode("p").alias("p"), "q").select("id", "p", F.explode("q").alias("q"))
    return keys.select("id", F.xxhash64("p", "q").alias("key"))


def shared_elsewhere(sets: DataFrame, apart: DataFrame) -> DataFrame:
    """``apart`` (id, c) with ``common``: how many shingles of a class are in a class of another component, too. No intersection with one of those is
    larger, so most texts of a template with words of their own need no comparison. Classes without such a shingle are left out."""
    held = sets.join(apart, "id").select("id", "c", F.explode("shingles").alias("s"))
    several = held.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("s")
    common = held.join(several, "s", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("common"))
    return apart.join(common, "id")


def link_classes(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame | None:
    """id, c: components of the classes (id, n_shingles, digest, a, b, bits) that have a link to another; None without links."""
    open_ = save(tables(classes), "tables").withColumn("c", F.col("id"))
    sets, loose, label, tested = None, None, None, []
    for r in range(ROUNDS):
        # tables whose classes are of several components, each with a hub that all others are compared with
        hub = F.min(F.struct(F.xxhash64(F.lit(r), "id").alias("h"), F.col("id").alias("hub"), F.col("c").alias("hub_c"))).alias("m")
        mixed = open_.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), hub).where("lo <> hi").select("key", "m.hub", "m.hub_c")
        met = save(open_.join(mixed, "key"), "buckets")
        if not met.limit(1).count():
            return label
        if sets is None:
            nodes = save(classes.join(met.select("id").distinct(), "id", "left_semi").select("id", "digest", "doc_id"), "nodes")
            texts = docs.where("text is not null").select(F.col("doc_id").alias("_doc"), "text")
            wanted = nodes.select("doc_id").distinct()
            picked = texts.join(wanted, texts["_doc"].eqNullSafe(wanted["doc_id"]), "left_semi")
            sets = save(shingle_sets(picked).dropDuplicates(["digest"]).join(nodes.select("id", "digest"), "digest").select("id", "shingles"), "sets")
        pairs = met.where("c <> hub_c").select(F.least("id", "hub").alias("x"), F.greatest("id", "hub").alias("y")).distinct()
        if tested:
            pairs = pairs.join(reduce(DataFrame.union, tested), ["x", "y"], "left_anti")
        tested.append(save(pairs, "pairs"))
        found = save(verified(tested[-1], classes, sets, percent), "links")
        if found.limit(1).count():
            # what two rounds leave apart is merged by the next call, before the rest is compared by the last one
            label, loose = merged(found if loose is None else found.union(loose), label, None if r == ROUNDS - 1 else 2)
        open_ = met.select("id", "key")
        open_ = open_.join(label, "id", "left").select("id", "key", F.coalesce("c", "id").alias("c")) if label is not None else open_.withColumn("c", F.col("id"))
    # classes that share a hash of the first collection, but are still apart; a pair is met under its first shared hash only
    # and has to share a hash of the second collection, which makes it a pair of the same tables
    n = bands(percent)
    apart = save(shared_elsewhere(sets, save(open_.select("id", "c").distinct(), "apart")), "common")
    may = classes.join(apart, "id").where(100 * F.col("common") >= percent * F.col("n_shingles"))
    placed = may.select("id", "c", "common", "n_shingles", "a", "b", "bits", F.posexplode("a").alias("band", "v"))
    mixed = placed.groupBy("band", "v").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("band", "v")
    pair = [f"l.a[{i}] = r.a[{i}]" for i in range(n)]
    meets = "CASE " + " ".join(f"WHEN {p} THEN {i}" for i, p in enumerate(pair)) + " END = l.band"
    tabled = " OR ".join(p.replace(".a[", ".b[") for p in pair)
    sized = f"100 * least(l.n_shingles, r.n_shingles) >= {percent} * greatest(l.n_shingles, r.n_shingles)"
    sized += f" AND {100 + percent} * least(l.common, r.common) >= {percent} * (l.n_shingles + r.n_shingles)"
    placed = save(placed.join(mixed, ["band", "v"], "left_semi"), "apart")
    placed = save(placed.join(fine(sets.join(placed.select("id").distinct(), "id", "left_semi")), "id"), "fine")
    # the cheap conditions first: most pairs end there
    on = F.expr(f"l.band = r.band AND l.v = r.v AND l.id < r.id AND l.c <> r.c AND {sized}")
    on = on & (F.expr(f"{FINE} - (" + " + ".join(f"bit_count(l.fine[{i}] ^ r.fine[{i}])" for i in range(FINE // 64)) + ")") >= least_fine(percent))
    on = on & F.expr(f"{meets} AND ({tabled})")
    cross = placed.alias("l").join(placed.alias("r"), on).select(F.col("l.id").alias("x"), F.col("r.id").alias("y"))
    cross = cross.join(reduce(DataFrame.union, tested), ["x", "y"], "left_anti")
    found = save(verified(cross, classes, sets, percent), "links")
    rest = found if loose is None else found.union(loose)
    return components(rest, label) if rest.limit(1).count() else label


def _labelled(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, h, n_shingles, c (class of the component; null without shingles), component_id of every row."""
    sig = save(signatures(docs, bands(percent)).withColumn("row", F.monotonically_increasing_id()), "signatures")
    rows = sig.select("doc_id", "h", "n_shingles", "digest")
    classes = (
        sig.where("n_shingles > 0")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("row", "n_shingles", "a", "b", "bits")).alias("s"))
        .select(F.col("s.row").alias("id"), "doc_id", "digest", "s.n_shingles", "s.a", "s.b", "s.bits")
    )
    classes = save(classes, "classes")
    label = link_classes(docs, classes, percent)
    named = classes.select("id", "digest", "doc_id")
    named = named.join(label, "id", "left").withColumn("c", F.coalesce("c", "id")) if label is not None else named.withColumn("c", F.col("id"))
    least = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    by_digest = named.join(least, "c").select(F.col("digest").alias("_digest"), "c", "component_id")
    some = rows.where("digest is not null").join(by_digest, F.col("digest") == F.col("_digest"))
    none = rows.where("digest is null").select("*", F.lit(None).cast("long").alias("c"), F.col("doc_id").alias("component_id"))
    columns = ["doc_id", "h", "n_shingles", "c", "component_id"]
    return some.select(*columns).union(none.select(*columns))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; links are pairs of a similarity of ``percent`` or more."""
    return _labelled(docs, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, of which one row of each component stays: of its least doc_id, the text of least
    hash, and where several rows have both, the least row in column order. Rows without words all stay."""
    one_id, one_h, copies, of = fresh(docs, "_one_id", "_one_h", "_copies", "_of")
    rows = _labelled(docs, percent)
    of_group = rows.where("c is not null and doc_id <=> component_id").groupBy("c", "doc_id", "h").count().groupBy("c").agg(F.min(F.struct("doc_id", "h", "count")).alias("m"))
    wordless = rows.where("c is null").select("doc_id", "h", F.lit(1).cast("long").alias("count")).distinct()
    keepers = of_group.select("m.*").union(wordless).toDF(one_id, one_h, copies)
    hashed = docs.withColumn(of, F.xxhash64(docs["text"]))
    joined = hashed.join(keepers, hashed["doc_id"].eqNullSafe(keepers[one_id]) & (hashed[of] == keepers[one_h]))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = joined.where(f"{copies} = 1").select(*columns)
    # repeated rows: sums on the map side, so a group of any size is no task's alone
    more = joined.where(f"{copies} > 1").groupBy(one_id, one_h).agg(F.min(F.struct(*columns)).alias(of)).select(f"{of}.*")
    return once.union(more)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
