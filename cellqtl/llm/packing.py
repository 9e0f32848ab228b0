"""Best-fit packing by a grouping genetic algorithm.

Documents become token sequences (their ids, then one end id); longer ones than a bin are cut into whole bins and a first
piece with the rest. Pieces shorter than a bin are dealt to blocks of bounded size, and each block to ``ISLANDS`` islands that evolve
populations of their own. An individual is a grouping of the block's pieces into bins: crossover injects another parent's
well-filled bins whole, drops bins that hold a piece twice over, and best-fits what was displaced; mutation opens the
emptiest bins again. After each of ``EPOCHS`` epochs the elite of every island migrates to the next island of its block, by a join. The best
individual of a block tells its bins. Well-filled bins are final; the pieces of the others are dealt to new, fewer blocks, until
one block is left, ``ROUNDS`` rounds are over, or less than a fifth of the pieces found a final bin in a round; then all bins are final.

Defined cases: null text is empty and gives the end id alone; null ids are documents like others; repeated rows are packed
each; an empty table gives an empty result; extra columns are ignored by the query and kept by :func:`pack`, but for columns
called sequence_id and offset, which its own take the place of.
"""

from __future__ import annotations

import base64
import bisect
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import fresh, save, slices, table

CAPACITY, END_ID = 2048, 0
#: Pieces of a block on average, the fill from which a bin is final, and the most rounds.
BLOCK, FINAL, ROUNDS = 4000, 0.995, 6
ISLANDS, EPOCHS = 2, 2
POPULATION, GENERATIONS = 6, 8
#: Bytes of pre-tokens and their ids that a task remembers, and characters of the longest one it does.
REMEMBERED, LONGEST = 48 << 20, 64

_libraries: dict[tuple, tuple] = {}


class _Remembered(dict):
    """Ids of pre-tokens as bytes; what is missing is encoded and, if short, kept; all is dropped beyond REMEMBERED bytes."""

    def __init__(self, encode_one) -> None:
        super().__init__()
        self.encode_one, self.size = encode_one, 0

    def __missing__(self, part: str) -> bytes:
        ids = array("I", self.encode_one(part)).tobytes()
        if len(part) <= LONGEST:
            if self.size > REMEMBERED:
                self.clear()
                self.size = 0
            self[part] = ids
            self.size += 200 + 4 * len(part) + len(ids)
        return ids


def encoder(path: str, ranks: str | None = None):
    """A function from texts to token ids as little-endian 32-bit bytes, with a memory of pre-tokens of its own. ``ranks``: the
    tokenizer's vocabulary as ranks, which a second library encodes single pre-tokens with, some four times as fast; without
    it the tokenizer does that, too. The pre-tokenizer never joins what stands on the two sides of a lone space, which goes
    with the right side, so such parts are encoded once and remembered. Texts with other white space than lone spaces and
    line feeds, or with special tokens, go through the tokenizer whole."""
    if (path, ranks) not in _libraries:  # a vocabulary of fixed size, loaded once by a worker
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        one = lambda part: t.encode(part, add_special_tokens=False).ids
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table_ = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
            one = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={}).encode_ordinary
        _libraries.clear()
        _libraries[path, ranks] = t, one
    t, one = _libraries[path, ranks]
    memory = _Remembered(one)

    def encode(texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for x in texts:
            if "<|" in x or "\0" in x or " ".join(x.split()) != x.replace("\n", " "):
                out.append(array("I", t.encode(x, add_special_tokens=False).ids).tobytes())
            else:
                out.append(b"".join(map(memory.__getitem__, x.replace(" ", "\0 ").split("\0"))))
        return out

    return encode


def encode(texts: list[str], path: str, ranks: str | None = None) -> list[bytes]:
    return encoder(path, ranks)(texts)


def cut(ids: bytes) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids with the end id after them."""
    data = ids + int(END_ID).to_bytes(4, "little")
    n = len(data) // 4
    first = n % CAPACITY or CAPACITY
    edges = [0, *range(first, n + 1, CAPACITY)]
    return [(k, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        of = encoder(tokenizer, ranks)
        for b in slices(batches):
            ids, rows = b.column(0), []
            at = []
            for i, x in enumerate(of([t or "" for t in b.column(1).to_pylist()])):
                for p in cut(x):
                    at.append(i)
                    rows.append(p)
            columns = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), pa.array(columns[0].astype("int32")), *map(pa.array, columns[1:])], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


Bins = list[tuple[int, list[int]]]  # fill, places of pieces


def best_fit(sizes: np.ndarray, places: list[int], bins: Bins) -> Bins:
    """Put pieces, largest first, each into the bin where least room is left."""
    room = sorted((CAPACITY - f, i) for i, (f, _) in enumerate(bins))
    bins = [(f, [*m]) for f, m in bins]
    for p in sorted(places, key=lambda i: -sizes[i]):
        s = int(sizes[p])
        k = bisect.bisect_left(room, (s, -1))
        if k < len(room):
            left, i = room.pop(k)
            bins[i] = (bins[i][0] + s, bins[i][1])
            bins[i][1].append(p)
            bisect.insort(room, (left - s, i))
        else:
            bins.append((s, [p]))
            bisect.insort(room, (CAPACITY - s, len(bins) - 1))
    return bins


def fitness(bins: Bins) -> tuple[int, float]:
    """Fewer bins, then bins of more uneven fill, which later rounds close more easily."""
    return len(bins), -sum((f / CAPACITY) ** 2 for f, _ in bins)


def crossover(sizes: np.ndarray, mine: Bins, other: Bins, rng: np.random.Generator) -> Bins:
    """Inject some of the other's best-filled bins whole."""
    good = sorted(other, key=lambda b: -b[0])[: max(1, len(other) // 2)]
    take = [good[i] for i in rng.choice(len(good), max(1, len(good) // 2), replace=False)]
    inside = {p for _, m in take for p in m}
    kept, displaced = list(take), []
    for f, m in mine:
        if inside.isdisjoint(m):
            kept.append((f, m))
        else:
            displaced += [p for p in m if p not in inside]
    return best_fit(sizes, displaced, kept)


def mutate(sizes: np.ndarray, bins: Bins, rng: np.random.Generator) -> Bins:
    """Open the emptiest bins and a few others."""
    order = sorted(range(len(bins)), key=lambda i: bins[i][0])
    drop = set(order[: max(2, len(bins) // 50)]) | set(rng.integers(0, len(bins), 4).tolist())
    loose = [p for i in drop for p in bins[i][1]]
    rng.shuffle(loose)
    return best_fit(sizes, loose, [b for i, b in enumerate(bins) if i not in drop])


def assignment(bins: Bins, n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for k, (_, members) in enumerate(bins):
        out[members] = k
    return out


def grouping(sizes: np.ndarray, of: np.ndarray) -> Bins:
    """The bins of an assignment."""
    fill = np.bincount(of, sizes).astype(int)
    members: list[list[int]] = [[] for _ in fill]
    for p, k in enumerate(of.tolist()):
        members[k].append(p)
    return [(int(f), m) for f, m in zip(fill, members, strict=True) if m]


def evolve(sizes: np.ndarray, population: list[Bins], seed: int) -> list[Bins]:
    """The population after GENERATIONS more generations, best first; a new one where it is empty. An individual that reaches
    the lower bound of bins ends the search."""
    rng = np.random.default_rng(seed)
    n, bound = len(sizes), -(-int(sizes.sum()) // CAPACITY)
    population = population or [best_fit(sizes, list(range(n)), [])]
    population.sort(key=fitness)
    if len(population[0]) <= bound or n < 3:
        return population[:1]
    while len(population) < POPULATION:  # others start from a quarter placed at random
        order = rng.permutation(n)
        bins: Bins = []
        for p in order[: n // 4]:
            bins = bins if bins and bins[-1][0] + sizes[p] <= CAPACITY else [*bins, (0, [])]
            bins[-1] = (bins[-1][0] + int(sizes[p]), [*bins[-1][1], int(p)])
        population.append(best_fit(sizes, order[n // 4 :].tolist(), bins))
    for _ in range(GENERATIONS):
        population.sort(key=fitness)
        if len(population[0]) <= bound:
            break
        a, b = rng.integers(0, POPULATION // 2), rng.integers(0, POPULATION)
        child = crossover(sizes, population[a], population[b], rng) if a != b else mutate(sizes, population[a], rng)
        population[-2:] = [mutate(sizes, population[0], rng), child]
    return sorted(population, key=fitness)[:POPULATION]


ISLAND = "block int, island int, lengths array<int>, population array<array<int>>, bins int, unevenness double"


def _epoch(seed: int):
    """One epoch of every island of a batch; what came from another island takes the place of the worst individual."""

    def run(batches):
        for b in slices(batches, 4):
            rows = []
            for r in b.to_pylist():
                sizes = np.array(r["lengths"], np.int64)
                found = [grouping(sizes, np.array(of)) for of in r["population"][: POPULATION - (r["migrant"] is not None)]]
                if r["migrant"] is not None:
                    found.append(grouping(sizes, np.array(r["migrant"])))
                found = evolve(sizes, found, seed * 1_000_003 + r["block"] * ISLANDS + r["island"])
                bins, uneven = fitness(found[0])
                rows.append((r["block"], r["island"], r["lengths"], [assignment(x, len(sizes)) for x in found], bins, uneven))
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in ISLAND.split(", ")])

    return run


def best_bins(lengths: DataFrame, seed: int) -> DataFrame:
    """block, place, bin for ``lengths`` (block, lengths)."""
    new = lengths.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "lengths", F.array().cast("array<array<int>>").alias("population"))
    islands = new.withColumn("migrant", F.lit(None).cast("array<int>"))
    for epoch in range(EPOCHS):
        grown = save(islands.mapInArrow(_epoch(seed * EPOCHS + epoch), ISLAND), "islands")
        elite = grown.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.get("population", F.lit(0)).alias("migrant"))
        islands = grown.select("block", "island", "lengths", "population").join(elite, ["block", "island"])
    best = grown.groupBy("block").agg(F.min_by(F.get("population", F.lit(0)), F.struct("bins", "unevenness", "island")).alias("best"))
    return best.select("block", F.posexplode("best").alias("place", "bin"))


def pack(parts: DataFrame) -> DataFrame:
    """``parts`` (with doc_id, piece, length, ids_crc32) plus sequence_id and offset."""
    parts = save(parts.drop("sequence_id", "offset"), "pieces")
    columns = parts.columns
    block, place, bin_, fill = fresh(parts, "_block", "_place", "_bin", "_fill")
    names = [F.col(f"`{c}`") for c in columns]
    whole = parts.where(F.col("length") == CAPACITY).select(
        *names, (F.shiftleft(F.lit(63).cast("long"), 56).bitwiseOR(F.monotonically_increasing_id())).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    loose, done, at = parts.where(F.col("length") < CAPACITY), [], 0
    left = loose.count()
    blocks, last = max(1, -(-left // BLOCK)), left <= BLOCK
    while True:
        key = F.pmod(F.xxhash64(F.lit(at), "doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
        order = Window.partitionBy(block).orderBy(F.desc("length"), "doc_id", "piece", "ids_crc32")
        # written, since the key of a row run again may differ
        dealt = save(save(loose.withColumn(block, key), "blocks").withColumn(place, F.row_number().over(order) - 1), "dealt")
        each = F.array_sort(F.collect_list(F.struct(F.col(place), F.col("length").cast("int").alias("length"))))
        lengths = dealt.groupBy(F.col(block).alias("block")).agg(each.alias("e")).select("block", F.transform("e", lambda x: x["length"]).alias("lengths"))
        found = best_bins(lengths, at).toDF(block, place, bin_)
        own = Window.partitionBy(block, bin_)
        # round, block and bin, told apart by their bits
        number = F.lit(at << 56).bitwiseOR(F.shiftleft(F.col(block).cast("long"), 24)).bitwiseOR(F.col(bin_).cast("long"))
        offset = F.sum("length").over(own.orderBy(place)) - F.col("length")
        packed = dealt.join(found, [block, place]).select(*names, number.alias("sequence_id"), offset.cast("long").alias("offset"), F.sum("length").over(own).alias(fill))
        packed = save(packed, "packed")
        full = F.lit(last) | (F.col(fill) >= FINAL * CAPACITY)
        done.append(packed.where(full).drop(fill))
        if last:
            break
        loose, before = packed.where(~full).select(*names), left
        left, at = loose.count(), at + 1
        blocks = max(1, -(-left // BLOCK))
        # where pieces hardly close bins (all over half a bin, say), meeting others anew would not help: all bins are final
        last = blocks == 1 or at == ROUNDS - 1 or left > 0.8 * before
    out = whole
    for d in done:
        out = out.union(d)
    return out


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    docs = table(spark, sf_dir, "documents")
    return pack(pieces(docs, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")))
