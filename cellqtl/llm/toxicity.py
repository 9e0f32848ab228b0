"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

The kernel is the gap-weighted subsequence kernel of order 3 on words: every ordered triple of characters whose span is
at most ``SPAN`` counts with weight ``DECAY ** span``, so ``l-o-s-e-r``, ``lo5ser`` and an inflected form stay close to
``loser``. Word ends are characters of their own. One insult makes a text toxic, so both SVMs are trained in the multiple-instance
form. The first, in the coordinates of Nystroem landmarks, has words as instances: those that explain the labels of toxic texts
against those of clean texts; its function sum_j alpha_j k(w, z_j) over landmarks z_j is folded into one sparse vector over
subsequences, so a word is scored by enumerating its own subsequences once. The second has labelled sentences as instances: the
largest margin of a word in a sentence and the sum of what its other words have above 0, so that weak words count together. A
text scores by its best sentence.

Defined cases: null or empty text scores as a text without words (lowest score); null, missing or repeated labels of a
document: nulls are ignored, repeated ones count as their maximum; with no usable label of both kinds every score is 0.
Extra columns of the input are ignored by :func:`score_texts` and kept by :func:`reject_toxic`.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .shared import save, slices, table

#: Largest span of a subsequence, decay for each character of span, letters of a window of a long word.
SPAN, DECAY, LETTERS = 5, 0.7, 24
#: Bounds of the labelled sample that the classifier is fitted on, and the longest text (characters) taken into it.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 2000, 4000, 60_000
#: Characters of the whole sample at most, in its order.
TRAIN_TOTAL = 60_000_000
LANDMARKS = 240
THRESHOLD = 0.7
#: Chunks whose margins a task remembers, and characters of the longest one it does.
REMEMBERED, LONGEST = 150_000, 64

_LETTERS = re.compile(r"[^\W\d_]+")
_SPELLED = re.compile(r"(?:(?<=\s)|^)\S(?:\s\S){3,}(?=\s|$)")
_ENDS = ".,;:!?%&$#*|()[]{}<>\"'-_=+/0123456789"
_STEPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b <= SPAN]


def words_of(chunk: str) -> list[str]:
    """The letter runs of a chunk, and the chunk with what stands between them left out (``l.o.s.e.r``, ``lo5er``)."""
    parts = _LETTERS.findall(chunk)
    if len(parts) > 1:
        parts.append("".join(parts))
    return [p for p in parts if len(p) > 1]


def chunks_of(text: str | None) -> set[str]:
    """Distinct chunks of a text between white space, and runs of four or more single characters joined."""
    if not text:
        return set()
    text = text.lower()
    found = {c.strip(_ENDS) for c in set(text.split())}
    for m in _SPELLED.finditer(text):
        found.add("".join(m[0].split()))
    return found


_SENTENCE = re.compile(r"[.!?]+\s|\n")


def sentences(text: str) -> list[list[str]]:
    """The chunks of each sentence of a text, runs of single characters joined besides."""
    out = []
    for part in _SENTENCE.split(text.lower()):
        found = [c for c in (c.strip(_ENDS) for c in part.split()) if c]
        found += ["".join(m[0].split()) for m in _SPELLED.finditer(part)]
        if found:
            out.append(found)
    return out


def windows(word: str) -> list[str]:
    if len(word) <= LETTERS:
        return [word]
    return [word[i : i + LETTERS] for i in range(0, len(word) - LETTERS // 2, LETTERS // 2)]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights (words x subsequences) of words of one length, the ends marked."""
    n, size = len(words), len(words[0]) + 2
    chars = np.empty((n, size), np.int64)
    chars[:, 0], chars[:, -1] = 1, 2
    chars[:, 1:-1] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(n, -1)
    codes, weights = [], []
    for a, b in _STEPS:
        if (k := size - a - b) > 0:
            codes.append((chars[:, :k] << 42) | (chars[:, a : a + k] << 21) | chars[:, a + b :])
            weights.append(np.full(k, DECAY ** (a + b - 2)))
    if not codes:
        return np.zeros((n, 1), np.int64), np.ones((1,))
    return np.concatenate(codes, 1), np.concatenate(weights)


def norms(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """sqrt k(w, w): equal subsequences of a word add up before they are squared."""
    order = np.argsort(codes, axis=1, kind="stable")
    c, w = np.take_along_axis(codes, order, 1), weights[order]
    new = np.ones_like(c, bool)
    new[:, 1:] = c[:, 1:] != c[:, :-1]
    group = np.cumsum(new.ravel()) - 1
    sums = np.bincount(group, w.ravel())
    rows = np.repeat(np.arange(len(c)), new.sum(1))
    return np.sqrt(np.bincount(rows, sums**2, len(c)))


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    at = defaultdict(list)
    for i, w in enumerate(words):
        at[len(w)].append(i)
    for idx in at.values():
        for k in range(0, len(idx), 5000):
            part = idx[k : k + 5000]
            yield np.array(part), [words[i] for i in part]


@dataclass
class Model:
    codes: np.ndarray  # sorted subsequences
    values: np.ndarray
    bias: float
    slope: float  # score = 1 / (1 + exp(-(slope * evidence + offset)))
    offset: float
    more: float = 0.0  # weight of the further words of a sentence

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._slots(self.codes)] = True

    @staticmethod
    def _slots(codes: np.ndarray) -> np.ndarray:
        return (codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def margins(self, words: list[str]) -> np.ndarray:
        """Signed distance of each word. Where a cheap bound (no two subsequences of the word equal) stays under
        ``bias - 0.2 * |bias|`` or -0.7, whichever is less, the bound is given instead."""
        out = np.full(len(words), -9.0)
        if len(self.codes):
            low = min(self.bias - 0.2 * abs(self.bias), -0.7)
            for at, part in by_length(words):
                codes, weights = subsequences(part)
                rows, cols = np.nonzero(self.maybe[self._slots(codes)])
                held = codes[rows, cols]
                pos = np.minimum(np.searchsorted(self.codes, held), len(self.codes) - 1)
                hit = np.bincount(rows, np.where(self.codes[pos] == held, self.values[pos], 0.0) * weights[cols], len(part))
                m = hit / np.sqrt((weights**2).sum()) + self.bias
                exact = np.nonzero(m >= low)[0]
                m[exact] = hit[exact] / norms(codes[exact], weights) + self.bias
                out[at] = m
        return out

    def chunk_margins(self, chunks: list[str]) -> list[float]:
        """Largest margin of any window of any word of each chunk; -9 without words."""
        owner, todo = [], []
        for i, c in enumerate(chunks):
            for w in words_of(c):
                for x in windows(w):
                    owner.append(i)
                    todo.append(x)
        best = np.full(len(chunks), -9.0)
        if todo:
            np.maximum.at(best, owner, self.margins(todo))
        return best.tolist()

    def evidence(self, margins: list[list[float]]) -> float:
        """Of the sentence that has most of it: the largest margin and, weighted, the sum of what its other words have above 0."""
        return max((max(m) + self.more * (sum(x for x in m if x > 0) - max(0.0, max(m))) for m in margins if m), default=-9.0)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        x = self.slope * np.asarray(evidence) + self.offset
        x = np.where(x < -30, -30 - np.log1p(np.maximum(-30 - x, 0)), x)  # order is kept far from the threshold, too
        x = np.where(x > 30, 30 + np.log1p(np.maximum(x - 30, 0)), x)
        return 1 / (1 + np.exp(-x))


EMPTY_MODEL = Model(np.zeros(0, np.int64), np.zeros(0), 0.0, 0.0, -60.0)


def _kernel(words: list[str], vocabulary: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Normalised kernel of words with the landmarks; dense: vocabulary x landmarks."""
    out = np.zeros((len(words), dense.shape[1]))
    for at, part in by_length(words):
        for k in range(0, len(part), 500):
            codes, weights = subsequences(part[k : k + 500])
            pos = np.minimum(np.searchsorted(vocabulary, codes), len(vocabulary) - 1)
            hit = vocabulary[pos] == codes
            x = np.zeros((len(codes), len(vocabulary)))
            rows = np.nonzero(hit)[0]
            np.add.at(x, (rows, pos[hit]), np.broadcast_to(weights, codes.shape)[hit])
            out[at[k : k + 500]] = (x @ dense) / norms(codes, weights)[:, None]
    return out


def _landmark_matrix(landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(at, *subsequences(part)) for at, part in by_length(landmarks)]
    vocabulary = np.unique(np.concatenate([c.ravel() for _, c, _ in parts]))
    dense = np.zeros((len(vocabulary), len(landmarks)))
    for at, codes, weights in parts:
        size = norms(codes, weights)
        for r, j in enumerate(at):
            np.add.at(dense[:, j], np.searchsorted(vocabulary, codes[r]), weights / size[r])
    return vocabulary, dense


def _squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Primal Newton steps of a linear SVM with squared hinge loss."""
    a = np.hstack([x, np.ones((len(x), 1))])
    reg = np.eye(a.shape[1])
    reg[-1, -1] = 1e-3
    w = np.zeros(a.shape[1])
    for _ in range(20):
        on = y * (a @ w) < 1
        s = a[on] * cost[on, None]
        new = np.linalg.solve(reg + s.T @ a[on], s.T @ y[on])
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w[:-1], float(w[-1])


def _fit_svm(positive: list[str], negative: list[str]) -> Model:
    def evenly(words: list[str], n: int) -> list[str]:
        return [words[i] for i in np.linspace(0, len(words) - 1, min(n, len(words))).astype(int)]

    landmarks = list(dict.fromkeys(evenly(positive, LANDMARKS // 2) + evenly(negative, LANDMARKS // 2)))
    vocabulary, dense = _landmark_matrix(landmarks)
    values, vectors = np.linalg.eigh(_kernel(landmarks, vocabulary, dense))
    keep = values > 1e-3
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = _kernel(positive + negative, vocabulary, dense) @ root
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    cost = np.where(y > 0, 40.0 * max(1.0, len(negative) / len(positive) / 4), 40.0)
    v, bias = _squared_hinge(x, y, cost)
    return Model(vocabulary, dense @ (root @ v), bias, 1.0, 0.0)


def copy_groups(texts: list[str]) -> list[int]:
    """A group number for each text; texts that share one of six minhashes of their 5-word shingles are of one group."""
    group, first = list(range(len(texts))), {}

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for i, t in enumerate(texts):
        w = t.lower().split()
        h = np.array([crc32(" ".join(w[k : k + 5]).encode()) for k in range(max(1, len(w) - 4))], np.uint64)
        for j, a in enumerate((2654435761, 2246822519, 3266489917, 668265263, 374761393, 1181783497)):
            key = (j, int(((h * np.uint64(a)) & np.uint64(0xFFFFFFFF)).min()))
            group[root(i)] = root(first.setdefault(key, i))
    return [root(i) for i in range(len(texts))]


def _explaining(toxic: list[np.ndarray], groups: list[int], in_clean: np.ndarray, n_clean: int) -> tuple[list[int], np.ndarray]:
    """Word numbers that tell toxic texts from clean ones beyond chance among all words seen, and in how many groups of copies
    each word of the toxic texts is."""
    size = len(in_clean)
    number = {g: i for i, g in enumerate(sorted(set(groups)))}
    n = len(number)
    pairs = np.unique(np.concatenate([t.astype(np.int64) * n + number[g] for t, g in zip(toxic, groups, strict=True)] or [np.zeros(0, np.int64)]))
    held = np.bincount(pairs // max(n, 1), minlength=size)
    base = n / (n + n_clean) if n else 0.5
    total = np.maximum(held + in_clean, 1)
    share = held / total
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = share * np.log(share / base) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - base)), 0)
    good = (share > base) & (in_clean <= 0.02 * total) & (total * gain > math.log(size + 1) + 1)
    chosen = np.nonzero(good)[0].tolist()
    return chosen, held


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """Fit on labelled texts held by the driver (a bounded sample). Words are numbered in code point order, so the model does
    not depend on the order of the texts."""
    seen: dict[str, int] = {}
    for t, y in zip(texts, labels, strict=True):
        seen[t or ""] = max(y, seen.get(t or "", 0))
    rows = sorted(seen.items())
    numbers: dict[str, int] = {}
    bags = []
    for t, _ in rows:
        found = {x for c in chunks_of(t) for w in words_of(c) for x in windows(w)}
        bags.append(np.array([numbers.setdefault(w, len(numbers)) for w in found], np.int32))
    words = sorted(numbers)
    place = np.empty(len(words), np.int32)
    for i, w in enumerate(words):
        place[numbers[w]] = i
    bags = [place[b] for b in bags]
    toxic, clean = ([b for b, (_, y) in zip(bags, rows, strict=True) if (y > 0) == want] for want in (True, False))
    in_clean = np.zeros(len(words), np.int64)
    for b in clean:
        in_clean[b] += 1
    positive, held = _explaining(toxic, copy_groups([t for t, y in rows if y > 0]), in_clean, len(clean))
    pool = np.nonzero(in_clean)[0]
    if not positive or not len(pool):
        return EMPTY_MODEL
    rng = np.random.default_rng(7)
    negative = set(rng.choice(pool, min(3000, len(pool)), replace=False).tolist())
    named = lambda idx: [words[i] for i in sorted(idx)]
    model = _fit_svm(named(positive), named(negative))
    for _ in range(3):
        m = model.margins(words)
        negative |= set(pool[np.argsort(-m[pool], kind="stable")[:1500]].tolist())
        # words of several toxic texts that clean ones never hold and that lie on the positive side are of the class, too
        positive = set(positive) | set(np.nonzero((held > 2) & (in_clean == 0) & (m > 0.3))[0].tolist())
        model = _fit_svm(named(positive), named(negative))
    return _fit_sentences(model, [t for t, y in rows if y > 0], [t for t, y in rows if y <= 0])


def _fit_sentences(model: Model, toxic: list[str], clean: list[str]) -> Model:
    """The second SVM, on labelled sentences: of each toxic text the sentence with most evidence is positive, of each clean one it is
    negative (multiple-instance form; two rounds, the first by the largest margin). Its features are the largest margin of a
    sentence and the sum of what other words have above 0; its weights and the scale of the score are fitted here."""
    scorer = Scorer(model)

    def parts(text: str) -> np.ndarray:
        """Of each sentence the largest margin and what its other words have above 0; margins of single words are not kept."""
        tops = ((max(m), m) for m in scorer.sentence_margins(text) if m)
        found = [(top, sum(x for x in m if x > 0) - max(0.0, top)) for top, m in tops]
        return np.array(found or [(-9.0, 0.0)])

    bags = {y: [parts(t) for t in texts] for y, texts in ((1, toxic), (0, clean))}

    def features(bag: np.ndarray) -> tuple[float, float]:
        top, more = bag[np.argmax(bag[:, 0] + model.more * bag[:, 1])]
        return max(top, -3.0), more

    for _ in range(2):
        x = np.array([features(b) for y in (1, 0) for b in bags[y]], float)
        y = np.r_[np.ones(len(toxic)), -np.ones(len(clean))]
        w, _bias = _squared_hinge(x, y, np.where(y > 0, max(1.0, len(clean) / max(1, len(toxic))), 1.0))
        model.more = float(np.clip(w[1] / w[0], 0.0, 1.0)) if w[0] > 0 else 0.0
    down = np.array([(b[:, 0] + model.more * b[:, 1]).max() for b in bags[0]])
    up = np.array([b[:, 0].max() for b in bags[1]])
    # 0.7 lies two fifths of the way from the clean texts' upper end to the median of the toxic texts' largest margins
    low, high = np.quantile(down, 0.999), np.median(up)
    if high <= low:
        low, high = min(low, high), max(low, high) + 1e-3
    cut = low + 0.4 * (high - low)
    model.slope = 4.0 / max(0.4 * (high - low), 1e-3)
    model.offset = math.log(THRESHOLD / (1 - THRESHOLD)) - model.slope * cut
    return model


def is_held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> list[Row]:
    """doc_id, toxic, text of distinct labelled rows outside the held-out fold: of at most TRAIN_TOXIC toxic and TRAIN_CLEAN
    clean doc_ids in the order of their hash, as many rows at most (of up to TRAIN_CHARS characters), the first text of each
    id before the second of any; all of them where there are fewer; no more than TRAIN_TOTAL characters in all."""
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .where(~is_held_out())
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    )
    fitting = docs.where(f"text is not null and length(text) <= {TRAIN_CHARS}").select("doc_id", "text")
    ids = fitting.select("doc_id").distinct().join(known, "doc_id")
    order, bounds = [F.xxhash64("doc_id"), F.col("doc_id")], ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))
    first = lambda rows, order: reduce(DataFrame.union, (rows.where(f"toxic = {y}").orderBy(*order).limit(n) for y, n in bounds))
    picked = save(first(ids, order), "picked")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    rows = fitting.join(F.broadcast(picked), "doc_id").distinct().withColumn("nth", nth).where(f"nth <= {max(n for _, n in bounds)}")
    # at most TRAIN_TOXIC + TRAIN_CLEAN rows from here on
    few = save(first(save(rows, "sample"), [F.col("nth"), *order]), "few")
    before = Window.orderBy("nth", *order, F.xxhash64("text"), "toxic").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = few.withColumn("total", F.sum(F.length("text")).over(before)).where(F.col("total") <= TRAIN_TOTAL)
    return whole.select("doc_id", "toxic", "text").collect()


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the sample of labelled rows."""
    rows = sample(docs, labels)
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows])


class Scorer:
    """Evidence of whole texts. Margins of chunks of up to LONGEST characters are remembered, REMEMBERED of them at most, as long
    as the task that owns the scorer runs."""

    def __init__(self, model: Model) -> None:
        self.model, self.memory = model, {}

    def _margins(self, chunks: set[str]) -> dict[str, float]:
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        new = list(chunks - self.memory.keys())
        of = dict(zip(new, self.model.chunk_margins(new), strict=True))
        self.memory.update((c, m) for c, m in of.items() if len(c) <= LONGEST)
        return of

    def sentence_margins(self, text: str | None) -> list[list[float]]:
        parts = sentences(text or "")
        of = self._margins(set().union(*parts))
        return [[of[c] if c in of else self.memory[c] for c in p] for p in parts]

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for k in range(0, len(texts), 200):
            bags = [chunks_of(t) for t in texts[k : k + 200]]
            of, known = self._margins(set().union(*bags)), self.memory
            for i, b in enumerate(bags):
                m = [of[c] if c in of else known[c] for c in b]
                out[k + i] = max(m, default=-9.0)
                # only where two words have a margin above 0 can a sentence have more than its best word
                if self.model.more and sum(x > 0 for x in m) > 1:
                    held = {c: v for c, v in zip(b, m, strict=True) if v > 0}
                    out[k + i] = max(out[k + i], self.model.evidence([[held[c] for c in p if c in held] for p in sentences(texts[k + i])]))
        return out

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        return self.model.probability(self.evidence(texts))


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for each row; texts never leave their partition."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers, whatever the input

    def run(batches):
        scorer = Scorer(shared.value)
        for b in slices(batches):
            p = scorer.probabilities(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype("int32"))], ["doc_id", "score", "predicted"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, score double, predicted int")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose predicted class is not toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(shared.value)
        for b in slices(batches):
            yield b.filter(pa.array(scorer.probabilities(b.column(at).to_pylist()) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_texts(docs, model).select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
