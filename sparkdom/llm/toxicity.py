"""Toxicity classifier with counterfactual regularisation.

A logistic model over hashed words and word beginnings, with an L1 penalty. Labelled
texts are split into sentences, and sentences are rewritten: one that names a group names
another in its place; one that names none is given a mention of one group, and of
another. The squared change of the score between the versions is penalised, so that the
terms themselves carry no weight and a neutral mention does not move a score. `gaps`
reports what is left of that.

The sample is bounded (`bound` labelled keys), and so are what a text gives (SENTENCES)
and the features (MOST_FEATURES, those that tell most about the label).

Defined cases: a null text is an empty one and gets the score of the intercept; without
labelled rows, or with one class alone, every score is 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdom.llm import labelled
from sparkdom.llm.common import tidy

WORD = re.compile(r"[^\W\d_]+")
BUCKETS, MEMO = 1 << 22, 1 << 17
#: Where sentences end; sentences of a text that are given a mention; most features.
STOP, SENTENCES, MOST_FEATURES = re.compile(r"[.!?\n\u2026\u3002]+"), 4, 30_000
#: Lengths of word beginnings that are features besides the whole word.
PREFIXES = (4, 5, 6, 7)
#: Terms that name groups; each is swapped for another of its list.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("black", "white", "asian", "latino", "african", "european"),
    ("immigrant", "refugee", "foreigner", "native"), ("deaf", "blind", "disabled", "autistic"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)


def swaps(groups: tuple[tuple[str, ...], ...] = IDENTITY) -> dict[str, str]:
    return {t: g[(k + 1) % len(g)] for g in groups for k, t in enumerate(g)}


def of_word(word: str) -> list[int]:
    return [zlib.crc32(x.encode()) % BUCKETS for x in (f"w{word}", *(f"p{word[:n]}" for n in PREFIXES if len(word) >= n))]


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def counts(words: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets, and how many distinct words have each."""
    return np.unique(np.array([f for w in words for f in of_word(w)], np.int32), return_counts=True)


def change(before: set[str], after: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and the change of their counts from one version of a sentence to the other."""
    ids, n = counts(before - after)
    new, m = counts(after - before)
    every, at = np.unique(np.concatenate([ids, new]), return_inverse=True)
    d = np.bincount(at, np.concatenate([-n, m]), len(every)).astype(np.int64)
    return every[d != 0], d[d != 0]


def counterfactuals(text: str, groups: tuple[tuple[str, ...], ...] = IDENTITY) -> list[tuple[set[str], set[str]]]:
    """Words of a text's sentences in two versions that should score alike.

    Every sentence that names groups, with the next term of each list; and of the others the
    SENTENCES with the least hash, with a mention of a group against none, and against
    another of its list.
    """
    swap, out, plain = swaps(groups), [], set()
    for sentence in STOP.split(text):
        words = words_of(sentence)
        if named := words & swap.keys():
            out.append((words, (words - named) | {swap[w] for w in named}))
        elif words:
            plain.add((zlib.crc32(" ".join(sorted(words)).encode()), frozenset(words)))
    for h, words in sorted(plain, key=lambda x: (x[0], sorted(x[1])))[:SENTENCES] if groups else ():
        group = groups[h % len(groups)]
        one = group[h // len(groups) % len(group)]
        out += [(set(words), words | {one}), (words | {one}, words | {swap[one]})]
    return [(a, b) for a, b in out if a != b]


class Rows:
    """A sparse matrix by rows, over chosen buckets."""

    def __init__(self, ids: list[np.ndarray], values: list[np.ndarray], chosen: np.ndarray):
        rows, cols, vals = [np.array([], np.int64)], [np.array([], np.int64)], [np.array([])]
        for k, (i, v) in enumerate(zip(ids, values, strict=True) if len(chosen) else ()):
            at = np.searchsorted(chosen, i).clip(max=len(chosen) - 1)
            hit = chosen[at] == i
            rows.append(np.full(int(hit.sum()), k))
            cols.append(at[hit])
            vals.append(v[hit])
        self.row, self.col, self.val = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals).astype(np.float64)
        self.shape = (len(ids), len(chosen))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * r[self.row], self.shape[1])


def select(ids: list[np.ndarray], y: np.ndarray, least: int = 3, z: float = 4.0, most: int = MOST_FEATURES) -> np.ndarray:
    """Buckets whose share among toxic and other texts differs by z standard errors."""
    every, n = np.unique(np.concatenate(ids), return_counts=True)
    toxic, times = np.unique(np.concatenate([i for i, t in zip(ids, y, strict=True) if t]), return_counts=True)
    a = np.zeros(len(every))
    a[np.searchsorted(every, toxic)] = times
    pos, neg = y.sum(), len(y) - y.sum()
    p = n / len(y)
    score = np.abs(a / pos - (n - a) / neg) / np.sqrt(p * (1 - p) * (1 / pos + 1 / neg) + 1e-12)
    keep = np.flatnonzero((n >= least) & (score >= z))
    return np.sort(every[keep[np.argsort(-score[keep], kind="stable")[:most]]])


def _steepest(x: Rows, pairs: Rows, fairness: float) -> float:
    """The largest curvature that the smooth part of the objective can have, by power iteration."""
    n, m = x.shape[0], max(pairs.shape[0], 1)
    b, w, top = 1.0, np.ones(x.shape[1]), 1.0
    for _ in range(40):
        r = (b + x.dot(w)) / (4 * n)
        b, w = r.sum(), x.back(r) + (pairs.back(2 * fairness / m * pairs.dot(w)) if len(pairs.val) else 0)
        top = float(np.sqrt(b * b + w @ w)) or 1.0
        b, w = b / top, w / top
    return top


def fit(x: Rows, y: np.ndarray, pairs: Rows, l1: float = 5e-5, fairness: float = 5.0, steps: int = 2000) -> tuple[float, np.ndarray]:
    """Least mean log loss + fairness * mean squared score change + l1 * |w|, by proximal gradient with momentum."""
    n, m = x.shape[0], max(pairs.shape[0], 1)
    share = y.mean()
    b, w = float(np.log(share / (1 - share))), np.zeros(x.shape[1])
    pb, pw, t = b, w, 1.0
    step = 1 / (1.05 * _steepest(x, pairs, fairness))
    for _ in range(steps):
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        yb, yw = b + (t - 1) / t2 * (b - pb), w + (t - 1) / t2 * (w - pw)
        r = (1 / (1 + np.exp(-np.clip(yb + x.dot(yw), -40, 40))) - y) / n
        g = x.back(r) + (pairs.back(2 * fairness / m * pairs.dot(yw)) if len(pairs.val) else 0)
        pb, pw = b, w
        b, w = yb - step * r.sum(), yw - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        # momentum that points uphill starts anew
        t = 1.0 if (yb - b) * (b - pb) + (yw - w) @ (w - pw) > 0 else t2
    return b, w


class Model:
    def __init__(self, bias: float, weights: dict[int, float]):
        self.bias, self.weights, self.memo = bias, weights, {}

    def word(self, word: str) -> float:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            got = self.memo[word] = sum(self.weights.get(f, 0.0) for f in of_word(word))
        return got

    def raw(self, text: str) -> float:
        return self.bias + sum(map(self.word, sorted(words_of(text))))


def train(sample: DataFrame, text: str = "text", groups: tuple[tuple[str, ...], ...] = IDENTITY, fairness: float = 5.0) -> Model | None:
    """Fit on every row of sample (column y); its features, bounded by the sample, come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            got = [counts(words_of(t)) for t in texts]
            moved = [[change(*pair) for pair in counterfactuals(t, groups)] for t in texts]
            lists = [pa.array([g[k] for g in got], pa.list_(pa.int32())) for k in (0, 1)]
            lists += [pa.array([[c[k] for c in cs] for cs in moved], pa.list_(pa.list_(pa.int32()))) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["y", "ids", "n", "moved", "by"])

    rows = sample.select("y", text).mapInArrow(tidy(run), "y int, ids array<int>, n array<int>, moved array<array<int>>, by array<array<int>>").toArrow()
    y = rows.column("y").to_numpy().astype(np.float64)
    if not 0 < y.sum() < len(y):
        return None
    ids, n = ([v.values.to_numpy() for v in rows.column(c).combine_chunks()] for c in ("ids", "n"))
    moved, by = ([v.values.to_numpy() for v in rows.column(c).combine_chunks().flatten()] for c in ("moved", "by"))
    terms = np.array([f for g in groups for t in g for f in of_word(t)], np.int32)
    chosen = np.union1d(select(ids, y), terms)
    b, w = fit(Rows(ids, n, chosen), y, Rows(moved, by, chosen), fairness=fairness)
    return Model(b, {int(f): float(v) for f, v in zip(chosen, w, strict=True) if v})


def gaps(model: Model, sentences: list[str], groups: tuple[tuple[str, ...], ...] = IDENTITY, threshold: float = 0.7) -> list[tuple[tuple[str, ...], float, float]]:
    """For each list of terms: the largest mean change of the score by a mention, between any two of its terms or against none, and the share of mentions at threshold or above."""
    out = []
    of = lambda t: 1 / (1 + np.exp(-np.clip(model.raw(t), -40, 40)))
    bare = np.array([of(s) for s in sentences])
    for g in groups:
        named = np.array([[of(f"{s} {t}") for s in sentences] for t in g])
        means = np.array([bare.mean(), *named.mean(1)])
        out.append((g, float(means.max() - means.min()), float((named >= threshold).mean())))
    return out


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", threshold: float = 0.7, keep: bool = False) -> DataFrame:
    """key, score, predicted of every row; with keep, all columns of docs and `predicted` under a name of its own."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs if keep else docs.select(F.col(key), F.col(text))

    def scores(texts: pa.Array) -> np.ndarray:
        m = sent.value
        return np.array([1 / (1 + np.exp(-np.clip(m.raw(t.as_py() or ""), -40, 40))) if m else 0.0 for t in texts])

    if keep:
        at = docs.columns.index(text)

        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(scores(b.column(at)) < threshold))

        return rows.mapInArrow(tidy(rest), docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scores(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], [key, "score", "predicted"])

    return rows.mapInArrow(tidy(run), f"{key} {rows.schema[0].dataType.simpleString()}, score double, predicted int")


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, key: str = "doc_id", text: str = "text", bound: int = 5000) -> Model | None:
    """At most `bound` labelled keys are learned from."""
    return train(labelled.sample(docs.select(key, text), labels, "toxic", may_learn, bound, key), text)


def classify(docs: DataFrame, labels: DataFrame, may_learn: Column, key: str = "doc_id", text: str = "text", threshold: float = 0.7, bound: int = 5000) -> DataFrame:
    """key, score, predicted of every row of docs; other columns are left out."""
    return score(docs, learn(docs, labels, may_learn, key, text, bound), key, text, threshold)


def reject_toxic(docs: DataFrame, labels: DataFrame, may_learn: Column, key: str = "doc_id", text: str = "text", threshold: float = 0.7, bound: int = 5000) -> DataFrame:
    """docs without the rows that score threshold or more."""
    return score(docs, learn(docs, labels, may_learn, key, text, bound), key, text, threshold, keep=True)
