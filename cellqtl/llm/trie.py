"""Trie of shared beginnings of rebuilt conversations, from composable fingerprints of turns.

A rebuilt conversation is a head (the first turns of its base) and a suffix (its own further turns). Its texts are never put
together. A sequence of turns has an element (n, v) of a monoid: n turns and, in four lanes modulo a prime, v = sum of x_i * B**i
over the turns' hashes x_i, with (n, v) * (m, w) = (n + m, v + B**n * w). A scan gives every turn the element of its conversation up
to there; the rebuilt one up to there is head * (own head)**-1 * own, a few numbers for each turn. Rows with one depth and
fingerprint are one node. A turn is carried as a reference, the hash of role and text: it is verified that each reference has one
role and one text in the table, and that all rows of a node end in one reference. As a node's fingerprint and last
reference fix its parent's fingerprint, equality then holds for the whole sequence, from the root on. If either check fails,
everything is hashed anew with another salt.

The smallest member of a node owns it. A conversation's own nodes are the lower end of its path, so the subtree of a node is made of
pieces of its members' paths, and sums over it are sums over its members: nothing walks along the depth of the trie.

A conversation may have any number of turns: rows are dealt by ranges of conversation and turn, each range is scanned alone, and
elements of earlier ranges are put before it.

Defined cases: rows with a null conv_id belong to no conversation; a null role or text counts as empty; null turns come first; turns of
one number come in the order of the hash of role and text, repeated rows as repeated turns; conv_id % 5 has the sign of conv_id; a
conversation without turns left is a member of the root; an empty table has no nodes; further columns of the input are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import save, table

#: A conversation's base is the last one before it whose id is a multiple of FAMILY; a head has less than HEADS turns.
FAMILY, HEADS = 5, 9
#: A prime below 2**31, so that products of two numbers fit a long; lanes, packed by two.
PRIME, LANES = 2_147_483_647, 4
#: Digits of a position, so many bits each, that powers are looked up by.
BITS, DIGITS = 2, 16
#: Ids of conversations that are joined to one text.
IDS = 4096

NODE = ["depth", "fa", "fb"]
VALUES = [f"v{i}" for i in range(LANES)]


def _base(salt: int, lane: int) -> int:
    return 2 + int(sha256(f"{salt} {lane}".encode()).hexdigest(), 16) % (PRIME - 3)


def _longs(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


def power(base: int, n: Column) -> Column:
    """base**n modulo PRIME for n from 0 to 2**32."""
    out = None
    for k in range(DIGITS):
        digit = F.shiftrightunsigned(n.cast("long"), BITS * k).bitwiseAND((1 << BITS) - 1)
        part = F.element_at(_longs([pow(base, d << (BITS * k), PRIME) for d in range(1 << BITS)]), (digit + 1).cast("int"))
        out = part if out is None else out * part % PRIME
    return out


def lane(ref: Column, salt: int, i: int) -> Column:
    """The hash x of a turn in one lane."""
    return F.pmod(F.xxhash64(F.lit(salt), F.lit(i), ref), F.lit(PRIME))


def packed(v: list[Column]) -> list[Column]:
    return [(F.shiftleft(v[0], 31) + v[1]).alias("fa"), (F.shiftleft(v[2], 31) + v[3]).alias("fb")]


def unpacked(fa: Column, fb: Column) -> list[Column]:
    return [x for f in (fa, fb) for x in (F.shiftrightunsigned(f, 31), f.bitwiseAND(PRIME))]


def one_text_each(turns: DataFrame) -> bool:
    """Whether each reference of ``turns`` (ref, role, text) has one role and one text."""
    g = turns.groupBy("ref").agg(*(f(c).alias(f"{n}_{c}") for c in ("role", "text") for n, f in (("least", F.min), ("most", F.max))))
    return not g.where("least_role <> most_role or least_text <> most_text").limit(1).count()


def positions(conversations: DataFrame, salt: int = 0) -> DataFrame | None:
    """conv_id, pos (from 1), ref, bytes, b (bytes up to there) and v0 to v3 of every turn; None if a reference has two texts."""
    role, text = (F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", role, text)
    turns = turns.withColumn("ref", F.xxhash64(F.lit(salt), "role", "text"))
    if not one_text_each(turns):
        return None
    order = ["conv_id", "turn", "_tie", "_row"]
    slim = turns.select("conv_id", "turn", F.xxhash64("role", "text").alias("_tie"), F.monotonically_increasing_id().alias("_row"), "ref", F.octet_length("text").cast("long").alias("bytes"))
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = save(ranged.select("conv_id", "ref", "bytes", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "ranges")
    w = Window.partitionBy("part", "conv_id").orderBy("at")
    terms = {f"v{i}": lane(F.col("ref"), salt, i) * power(_base(salt, i), F.col("n")) % PRIME for i in range(LANES)}
    local = ranged.withColumn("n", F.row_number().over(w).cast("long")).withColumns(terms)
    local = save(local.withColumns({v: F.sum(v).over(w) % PRIME for v in VALUES} | {"b": F.sum("bytes").over(w)}), "scanned")
    # the element of each conversation's rows in a range, and of those in the ranges before it
    ends = local.groupBy("conv_id", "part").agg(F.max("n").alias("n"), *(F.max_by(c, "n").alias(c) for c in (*VALUES, "b")))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ends = ends.withColumn("n0", F.sum("n").over(before))
    ends = ends.withColumns({v: F.col(v) * power(_base(salt, i), F.coalesce("n0", F.lit(0))) % PRIME for i, v in enumerate(VALUES)})
    carry = ends.select("conv_id", "part", "n0", *(F.sum(c).over(before).alias(f"{c}0") for c in (*VALUES, "b"))).where("n0 is not null")
    all_rows = local.join(F.broadcast(carry), ["conv_id", "part"], "left")  # one row at most for each range
    n0 = F.coalesce("n0", F.lit(0))
    moved = [((F.coalesce(f"{v}0", F.lit(0)) + F.when(F.col("n0").isNull(), F.col(v)).otherwise(F.col(v) * power(_base(salt, i), n0) % PRIME)) % PRIME).alias(v) for i, v in enumerate(VALUES)]
    return all_rows.select("conv_id", (F.col("n") + n0).alias("pos"), "ref", "bytes", (F.col("b") + F.coalesce("b0", F.lit(0))).alias("b"), *moved)


def members(turns: DataFrame, salt: int = 0) -> DataFrame:
    """A row for each rebuilt conversation and each of its beginnings: conv_id, depth, fa, fb (the fingerprint), ref and bytes of the
    last turn, rest (bytes from that turn on) and len (turns of the whole). ``turns`` as from :func:`positions`, written."""
    head = F.struct("pos", "ref", "bytes", "b", *VALUES)
    each = turns.groupBy("conv_id").agg(F.max("pos").alias("own"), F.max("b").alias("own_bytes"), F.array_sort(F.collect_list(F.when(F.col("pos") < HEADS, head))).alias("heads"))
    each = each.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    base = each.select(F.col("conv_id").alias("base"), F.col("heads").alias("of_base"))
    each = each.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(base, "base", "left")
    each = each.withColumn("head", F.when(F.col("h") > 0, F.slice("of_base", F.lit(1), F.greatest("h", F.lit(1)).cast("int"))))
    each = each.withColumn("head", F.coalesce("head", F.slice("heads", 1, 0))).withColumn("hb", F.size("head").cast("long"))
    end, cut = F.get("head", F.col("hb").cast("int") - 1), F.get("heads", (F.least("h", "own") - 1).cast("int"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    left = F.when(F.col("own") > F.col("h"), F.col("own_bytes") - zero(cut["b"])).otherwise(F.lit(0).cast("long"))
    each = each.select(
        "conv_id", "head", "hb", "h", "own_bytes", (zero(end["b"]) + left).alias("total"), (F.col("hb") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len"),
        *(zero(end[v]).alias(f"head_{v}") for v in VALUES), *(zero(cut[v]).alias(f"cut_{v}") for v in VALUES),
    )
    each = save(each, "heads")
    long = lambda n, name: F.lit(n).cast("long").alias(name)
    roots = each.select("conv_id", long(0, "depth"), long(0, "fa"), long(0, "fb"), long(0, "ref"), long(0, "bytes"), F.col("total").alias("rest"), "len")
    heads = each.select("conv_id", "total", "len", F.explode("head").alias("t"))
    heads = heads.select("conv_id", F.col("t.pos").alias("depth"), *packed([F.col(f"t.{v}") for v in VALUES]), "t.ref", "t.bytes", (F.col("total") - F.col("t.b") + F.col("t.bytes")).alias("rest"), "len")
    own = turns.join(each.drop("head", "total"), "conv_id").where("pos > h")
    back = [F.element_at(_longs([pow(_base(salt, i), -k, PRIME) for k in range(HEADS)]), (F.col("h") - F.col("hb") + 1).cast("int")) for i in range(LANES)]
    put = [(F.col(f"head_{v}") + F.pmod(F.col(v) - F.col(f"cut_{v}"), F.lit(PRIME)) * back[i] % PRIME) % PRIME for i, v in enumerate(VALUES)]
    own = own.select("conv_id", (F.col("hb") + F.col("pos") - F.col("h")).alias("depth"), *packed(put), "ref", "bytes", (F.col("own_bytes") - F.col("b") + F.col("bytes")).alias("rest"), "len")
    return roots.unionByName(heads).unionByName(own)


def digests(ends: DataFrame) -> DataFrame:
    """depth, fa, fb, ends_sha256: the digest of the ids of the conversations that end in each node, in ascending order. Ids are joined to
    texts of IDS neighbours at most; a task takes these in order and holds one at a time."""
    texts = ends.groupBy(*NODE, F.floor(F.col("conv_id") / IDS).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def run(batches):
        now, told = None, None
        for b in batches:
            out = []
            for *key, _, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key == now:
                    told.update(b"," + ids.encode())
                else:
                    if now is not None:
                        out.append((*now, told.hexdigest()))
                    now, told = key, sha256(ids.encode())
            yield _rows(out)
        yield _rows([(*now, told.hexdigest())] if now is not None else [])

    def _rows(rows):
        return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.string())], [*NODE, "ends_sha256"])

    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "block").mapInArrow(run, "depth long, fa long, fb long, ends_sha256 string")


def nodes(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256, and the fingerprint in fa and fb."""
    salt = 0
    while True:
        turns = positions(conversations, salt)
        if turns is not None:
            rows = save(members(save(turns, "turns"), salt), "members")
            last = [F.min("ref").alias("ref"), F.max("ref").alias("other")]
            owned = save(rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.min_by("rest", "conv_id").alias("rest"), F.max("len").alias("longest"), *last), "owned")
            if not owned.where("ref <> other").limit(1).count():
                break
        salt += 1
    # of each conversation the nodes it owns: the first one's depth and key, and whether the last one is a leaf
    chains = owned.groupBy("conv_id").agg(
        F.min("depth").alias("lo"), F.max("rest").alias("lo_rest"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"), *(F.min_by(c, "depth").alias(c) for c in ("fa", "fb", "ref"))
    )
    lanes = unpacked(F.col("fa"), F.col("fb"))
    above = packed([F.pmod(x - lane(F.col("ref"), salt, i) * power(_base(salt, i), F.col("lo")) % PRIME, F.lit(PRIME)) for i, x in enumerate(lanes)])
    chains = chains.select("conv_id", "lo", "lo_rest", "leaf", (F.col("lo") - 1).alias("depth"), *above)
    chains = chains.join(owned.select(*NODE, F.col("conv_id").alias("up")), NODE, "left").drop(*NODE)
    depth, lo = F.col("depth"), F.col("lo")
    of_tree = F.when(lo <= depth, F.col("rest")).when(lo > depth, F.col("lo_rest")).otherwise(F.lit(0).cast("long"))
    summed = rows.join(chains, "conv_id", "left").groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        *(F.min_by(c, "conv_id").alias(c) for c in ("len", "lo", "up")),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.coalesce("leaf", F.lit(0).cast("long"))).alias("n_leaves"),
        (F.sum("rest") - F.sum(of_tree)).alias("saved_tokens"),
        F.count_if(lo == depth + 1).alias("begun"),
    )
    parent = F.when(depth == 0, F.lit(None)).when(depth > lo, F.col("conv_id")).otherwise(F.col("up"))
    told = summed.join(digests(rows.where("depth = len").select(*NODE, "conv_id")), NODE, "left")
    return told.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", (F.col("begun") + (F.col("len") > depth).cast("long")).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(sha256().hexdigest())).alias("ends_sha256"), "fa", "fb",
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(table(spark, sf_dir, "conversations")).drop("fa", "fb")


SQL = f"""
WITH bits AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
o AS (SELECT conv_id, list(struct_pack(r := COALESCE(role, ''), t := COALESCE(text, '')) ORDER BY turn NULLS FIRST, role, text) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, ts, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {HEADS} AS h FROM o, bits),
b AS (SELECT h.conv_id, list_concat(list_slice(COALESCE(p.ts, []), 1, h.h), list_slice(h.ts, h.h + 1, len(h.ts))) AS rs FROM h LEFT JOIN o p ON p.conv_id = h.conv_id - h.conv_id % {FAMILY}),
m AS (SELECT conv_id, d, len(rs) AS n, list_slice(rs, 1, d) AS k FROM (SELECT *, unnest(range(len(rs) + 1)) AS d FROM b)),
n AS (SELECT k, d, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, MAX(n) = d AS leaf, CASE WHEN d = 0 THEN 0 ELSE (COUNT(*) - 1) * strlen(k[d].t) END AS saved,
  COALESCE(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM m GROUP BY k, d),
s AS (SELECT list_slice(k, 1, a) AS k, SUM(saved) AS saved, COUNT(*) FILTER (leaf) AS leaves, COUNT(*) FILTER (d = a + 1) AS children FROM (SELECT *, unnest(range(d + 1)) AS a FROM n) GROUP BY 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, s.children AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN s ON s.k = n.k LEFT JOIN n p ON n.d > 0 AND p.d = n.d - 1 AND p.k = list_slice(n.k, 1, n.d - 1)
"""
