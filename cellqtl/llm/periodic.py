"""Runs of words that repeat with a period, found by longest common extensions (LCE) from a difference cover.

A run is a maximal stretch of consecutive words with smallest period q and at least max(SHORTEST, TIMES * q) words. A task joins
the words of a block of documents into one array, each document closed by a number of its own, and

1. meets the grid of every period: places i = 0, q, 2q, ... whose word equals the word q places on (a run of TIMES periods holds
   such a place within its first q words, and from there at least (TIMES - 2) * q + 1 equal words follow);
2. asks for the LCE of i and i + q. Only suffixes at places of a difference cover modulo MODULUS are sorted; for any i and j some
   d < MODULUS puts i + d and j + d on the cover, so an LCE compares d words at most and then takes the least of the
   neighbours' common prefixes between two ranks from a sparse table;
3. extends what is left backwards by the LCE of the reversed words, and keeps each stretch under its smallest period.

Defined cases: null or empty text has no words, no runs, and the hashes of nothing; a row with a null doc_id stays, and
:func:`looped` leaves its words alone; repeated rows give a row each; a text of any length is taken whole (a block holds one text at
least); an empty table gives an empty result; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import slices, table

#: A run has at least SHORTEST words and TIMES periods.
SHORTEST, TIMES = 6, 4
#: A perfect difference cover; every remainder is a difference of two of its members in one way.
MODULUS, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Words of a block of documents that are worked on at once (one document at least).
BLOCK = 250_000


def _shifts() -> np.ndarray:
    """shift[a, b]: the least d that puts a + d and b + d on the cover."""
    on = np.zeros(MODULUS, bool)
    on[list(COVER)] = True
    a, b, d = np.ogrid[:MODULUS, :MODULUS, :MODULUS]
    return (on[(a + d) % MODULUS] & on[(b + d) % MODULUS]).argmax(2)


SHIFT = _shifts()


class Extensions:
    """LCE queries on ``words``: numbers below 2**31 with documents that end in a number found once. ``part`` numbers the document
    of each place. Only places of one document are compared."""

    def __init__(self, words: np.ndarray, part: np.ndarray) -> None:
        self.words = np.concatenate([words, np.arange(-1, -2 * MODULUS - 1, -1)])  # so that no comparison leaves the array
        cover, n = np.array(COVER), len(words)
        at = (np.arange(0, n, MODULUS)[:, None] + cover).ravel()
        self.at = at[at < n]
        self.ordinal = np.zeros(MODULUS, np.int64)  # place p is sample p // MODULUS * len(COVER) + ordinal[p % MODULUS]
        self.ordinal[cover] = np.arange(len(cover))
        levels = self._sort(part[self.at])
        self._neighbours(levels)

    def _refine(self, order: np.ndarray, group: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Sort the samples that share a group by ``key`` (of each sample in ``open``); new groups. A group is named by the place in
        ``order`` at which it begins."""
        tied = self.open
        by = np.lexsort((key, group[tied]))
        moved = tied[by]
        new = np.ones(len(by), bool)
        new[1:] = (group[moved][1:] != group[moved][:-1]) | (key[by][1:] != key[by][:-1])
        first = np.ones(len(by), bool)
        first[1:] = group[moved][1:] != group[moved][:-1]
        starts = np.nonzero(first)[0]
        within = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
        place = group[moved] + within  # groups keep their stretch of the order
        order[place] = moved
        begin = np.nonzero(new)[0]
        size = np.diff(np.r_[begin, len(by)])
        out = group.copy()
        out[moved] = np.repeat(place[begin], size)
        self.open = moved[np.repeat(size > 1, size)]
        return out

    def _sort(self, part: np.ndarray) -> list[np.ndarray]:
        """Order the samples of each document: by MODULUS words, two at a time, then by the ranks of what follows, twice as far each
        time. Gives the groups after each doubling."""
        m = len(self.at)
        order = np.arange(m)
        starts = np.nonzero(np.r_[True, part[1:] != part[:-1]])[0] if m else np.zeros(0, np.int64)
        group = np.repeat(starts, np.diff(np.r_[starts, m]))
        self.open = order.copy()
        for t in range(0, MODULUS, 2):
            if not len(self.open):
                break
            p = self.at[self.open] + t
            second = self.words[p + 1] if t + 1 < MODULUS else 0
            group = self._refine(order, group, (self.words[p] << 31) + second)
        levels, step = [group], len(COVER)
        while len(self.open):  # equal MODULUS words lie before the end of the document, so the next sample is of it, too
            after = self.open + step
            group = self._refine(order, group, np.where(after < m, levels[-1][np.minimum(after, m - 1)], -1))
            levels.append(group)
            step *= 2
        self.rank = levels[-1]
        self.order = order
        return levels

    def _neighbours(self, levels: list[np.ndarray]) -> None:
        """Common prefixes of samples that are neighbours in order, and the sparse table of their minima."""
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        m, low = len(self.order), np.zeros(max(0, len(self.order) - 1), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = (a < m) & (b < m)
            same[same] = levels[k][a[same]] == levels[k][b[same]]
            step = len(COVER) << k
            low[same] += MODULUS << k
            a[same] += step
            b[same] += step
        left = np.nonzero((a < m) & (b < m))[0]
        p, q = self.at[a[left]], self.at[b[left]]
        for t in range(MODULUS):
            equal = self.words[p + t] == self.words[q + t]
            left, p, q = left[equal], p[equal], q[equal]
            low[left] += 1
        self.minima = [low.astype(np.int32)]
        while (width := 1 << len(self.minima)) <= len(low):
            x = self.minima[-1]
            self.minima.append(np.minimum(x[: len(low) - width + 1], x[width // 2 : width // 2 + len(low) - width + 1]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from places i and j on, i < j in one document."""
        out = np.zeros(len(i), np.int64)
        shift = SHIFT[i % MODULUS, j % MODULUS]
        live = np.arange(len(i))
        for t in range(MODULUS):
            asked = shift[live] > t
            met = self.words[i[live] + t] == self.words[j[live] + t]
            out[live[asked & met]] += 1
            live = live[met | ~asked]
            if not (shift[live] > t + 1).any():
                break
        p, q = i[live] + shift[live], j[live] + shift[live]
        a, b = (self.rank[x // MODULUS * len(COVER) + self.ordinal[x % MODULUS]] for x in (p, q))
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(float))[1] - 1  # largest power of two in the range
        more = np.zeros(len(live), np.int64)
        for k in np.unique(level):
            s = level == k
            more[s] = np.minimum(self.minima[k][low[s]], self.minima[k][high[s] - (1 << k)])
        out[live] += more
        return out


@dataclass
class Runs:
    """Runs of a block: number of the document, first word, length and period of each, by document, start and period."""

    part: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _grid(words: np.ndarray, part: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i on the grid of a period q, and q, where the next words equal those q places on. Documents lie from long to short,
    so those that can hold a run of q come first."""
    ends = np.cumsum(sizes)
    at, periods = [], []
    reach = np.searchsorted(-sizes, -np.maximum(SHORTEST, TIMES * np.arange(1, int(sizes[0] - 1) // TIMES + 1)) - 1, side="right") if len(sizes) else []
    for q, held in enumerate(reach, 1):  # sizes count the closing number
        if not held:
            break
        n = int(ends[held - 1])
        i = np.nonzero(words[: n - q : q] == words[q:n:q])[0] * q
        if len(i):
            i = i[(words[i + 1] == words[i + q + 1]) & (words[i + 2] == words[i + q + 2]) & (part[i] == part[i + q])]
            if len(i):
                at.append(i)
                periods.append(np.full(len(i), q))
    none = np.zeros(0, np.int64)
    return (np.concatenate(at), np.concatenate(periods)) if at else (none, none)


def runs_of(documents: list[np.ndarray]) -> Runs:
    """All runs of the documents, each an array of word numbers from 0 to 2**31."""
    by_size = sorted(range(len(documents)), key=lambda d: -len(documents[d]))
    sizes = np.array([len(documents[d]) + 1 for d in by_size], np.int64)
    none = np.zeros(0, np.int64)
    if not len(sizes):
        return Runs(none, none, none, none)
    starts = np.cumsum(sizes) - sizes
    part = np.repeat(np.arange(len(sizes)), sizes)
    words = np.concatenate([x for k, d in enumerate(by_size) for x in (documents[d], [-1 - k - 2 * MODULUS])]).astype(np.int64)
    padded = np.concatenate([words, np.arange(-1, -MODULUS, -1)])
    i, q = _grid(padded[: len(words) + 3], np.concatenate([part, [-1] * 3]), sizes)
    if not len(i):
        return Runs(none, none, none, none)
    forward = Extensions(words, part).of(i, i + q)
    held = forward >= (TIMES - 2) * q + 1
    i, q, forward = i[held], q[held], forward[held]
    if not len(i):
        return Runs(none, none, none, none)
    # backwards, on documents with something left, each reversed and closed by its number
    kept = np.unique(part[i])
    back_size = sizes[kept]
    back_start = np.cumsum(back_size) - back_size
    mirrored = np.concatenate([np.r_[words[starts[k] : starts[k] + sizes[k] - 1][::-1], words[starts[k] + sizes[k] - 1]] for k in kept])
    of = np.searchsorted(kept, part[i])
    last = back_start[of] + back_size[of] - 2  # mirrored place of a document's first word
    local = i - starts[part[i]]
    before = np.zeros(len(i), np.int64)
    ask = local > 0
    left, right = last[ask] - (local[ask] - 1), last[ask] - (local[ask] + q[ask] - 1)
    before[ask] = Extensions(mirrored, np.repeat(np.arange(len(kept)), back_size)).of(right, left)
    begin, length = local - before, before + q + forward
    held = length >= np.maximum(SHORTEST, TIMES * q)
    found = np.column_stack([np.array(by_size)[part[i]], begin, length, q])[held]
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :3] != found[:-1, :3]).any(1)  # a stretch goes under its smallest period
    found = found[new]
    found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
    return Runs(*found.T)


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, of one in ten with a loop from some word on, as the hash of its id says."""
    if doc_id is None or not words:
        return words
    h, n = crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _numbers(words: list[list[bytes]]) -> list[np.ndarray]:
    seen: dict[bytes, int] = {}
    for w in words:
        for x in w:
            if x not in seen:
                seen[x] = len(seen)
    return [np.fromiter(map(seen.__getitem__, w), np.int64, len(w)) for w in words]


def blocks(rows: Iterable[tuple[int | None, list[bytes]]]) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Rows in lists of about BLOCK words, one row at least."""
    held, size = [], 0
    for r in rows:
        if held and size + len(r[1]) > BLOCK:
            yield held
            held, size = [], 0
        held.append(r)
        size += len(r[1])
    if held:
        yield held


def report(rows: list[tuple[int | None, list[bytes]]]) -> Iterator[dict]:
    """A row of :func:`scan` for each document, given as its id and words."""
    runs = runs_of(_numbers([w for _, w in rows]))
    ends = np.searchsorted(runs.part, np.arange(len(rows) + 1))
    for k, (doc_id, words) in enumerate(rows):
        own = slice(ends[k], ends[k + 1])
        start, length, period = runs.start[own].tolist(), runs.length[own].tolist(), runs.period[own].tolist()
        out = {"doc_id": doc_id, "n_words": len(words), "starts": start, "lengths": length, "periods": period}
        told = sha256()
        dropped = np.zeros(len(words) + 1, np.int64)
        for s, n, q in zip(start, length, period, strict=True):
            told.update(b"%d,%d,%d\n" % (s, n, q))
            dropped[s + q] += 1
            dropped[s + n] -= 1
        kept = words
        if start:
            gone = np.cumsum(dropped[:-1]) > 0
            kept = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
        yield out | {"n_kept": len(kept), "runs_sha256": told.hexdigest(), "collapsed": b" ".join(kept)}


def scan(docs: DataFrame, loop: bool = False, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_kept, runs (start, length, period; by start, then period), runs_sha256, collapsed_sha256 and, with
    ``texts``, collapsed: the words kept, joined by one space. ``loop`` first puts loops into documents (:func:`looped`)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def rows(batches):
        for b in slices(batches):
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (t or b"").split()  # of bytes: splits at space and \t to \r only
                yield d, looped(d, words) if loop else words

    def work(batches):
        for held in blocks(rows(batches)):
            found = list(report(held))
            of = [x for r in found for x in zip(r["starts"], r["lengths"], r["periods"], strict=True)]
            flat = pa.StructArray.from_arrays([pa.array([x[k] for x in of], pa.int64()) for k in range(3)], fields=list(run))
            columns = {
                "doc_id": pa.array([r["doc_id"] for r in found]),
                "n_words": pa.array([r["n_words"] for r in found], pa.int64()),
                "n_kept": pa.array([r["n_kept"] for r in found], pa.int64()),
                "runs": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r["starts"]) for r in found)]), pa.int32()), flat),
                "runs_sha256": pa.array([r["runs_sha256"] for r in found]),
                "collapsed_sha256": pa.array([sha256(r["collapsed"]).hexdigest() for r in found]),
            }
            if texts:
                columns["collapsed"] = pa.array([r["collapsed"].decode() for r in found])
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = f"doc_id {kind}, n_words long, n_kept long, runs array<struct<start:long,length:long,period:long>>, runs_sha256 string, collapsed_sha256 string"
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(work, schema + ", collapsed string" * texts)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run of greatest length of every document (ties: smallest start, then period), and digests of all runs and of the words kept."""
    found = scan(table(spark, sf_dir, "documents"), loop=True, texts=False)
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    return found.withColumn("_r", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_r.start").alias("start"),
        (-F.col("_r.l")).alias("length"),
        F.col("_r.period").alias("period"),
        F.floor(1000 * -F.col("_r.l") / F.col("_r.period")).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
