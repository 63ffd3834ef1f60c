"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

    score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

so the pairwise part costs time linear in the features. Words are hashed, their values
square-rooted counts scaled to length one; structure statistics and the declared length
are cut into quantile bins that the sample gives.

Defined cases: a null text is an empty one and gets a score like any other; a null
n_chars falls back to the text's length; without labelled rows every score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdom.llm import labelled

WORDS, BINS, RANK = 1 << 14, 16, 8
WORD = re.compile(r"[^\W_]+")
STATS = ("log length", "declared length", "upper", "digit", "space", "punctuation", "symbol", "non-ASCII", "words a line", "repeated lines", "distinct words", "top word", "word length", "line end")
MEMO = 1 << 18
PUNCTUATION, SYMBOLS = b".,;:'\"!?()-", b"#$%&*+/<=>@[\\]^_`{|}~"


class Words:
    """Buckets of words, remembered within a worker."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def __call__(self, word: str) -> int:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            got = self.memo[word] = zlib.crc32(word.encode()) % WORDS
        return got


def features(text: str, n_chars: int | None, bucket: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, their values, and the structure statistics."""
    raw = text.encode()
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(len(raw), 1)
    words = Counter(WORD.findall(text.lower()))
    total = max(words.total(), 1)
    lines = text.split("\n")
    ends = Counter(x[-1:] for x in lines)
    stats = np.array([
        np.log1p(len(text)), np.log1p(max(n_chars if n_chars is not None else len(text), 0)), by[65:91].sum() / n, by[48:58].sum() / n, (by[32] + by[9:14].sum()) / n,
        by[list(PUNCTUATION)].sum() / n, by[list(SYMBOLS)].sum() / n, by[128:].sum() / n, total / len(lines), 1 - len(set(lines)) / len(lines),
        len(words) / total, max(words.values(), default=0) / total, sum(len(w) * k for w, k in words.items()) / total, ends["."] / len(lines),
    ])
    ids = np.fromiter(map(bucket, words), np.int32, len(words))
    tf = np.sqrt(np.fromiter(words.values(), np.float32, len(words)))
    return ids, tf / max(float(np.sqrt((tf * tf).sum())), 1e-9), stats


class Machine:
    def __init__(self, edges: np.ndarray, rank: int = RANK, seed: int = 7):
        size = WORDS + len(STATS) * BINS
        self.edges, self.w0 = edges, 0.0
        self.w = np.zeros(size, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (size, rank)).astype(np.float32)

    def row(self, ids: np.ndarray, values: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins = [WORDS + k * BINS + int(np.searchsorted(e, s, "right")) for k, (e, s) in enumerate(zip(self.edges, stats, strict=True))]
        return np.concatenate([ids, np.array(bins, np.int32)]), np.concatenate([values, np.full(len(bins), 0.5, np.float32)])

    def raw(self, ids: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[ids] * x[:, None]
        return float(self.w0 + self.w[ids] @ x + 0.5 * ((vx.sum(0) ** 2).sum() - (vx * vx).sum()))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, rate: float = 0.1, decay: float = 1e-5, batch: int = 128, seed: int = 7) -> None:
        """AdaGrad on the log loss."""
        rng = np.random.default_rng(seed)
        share = float(y.mean().clip(0.01, 0.99))
        self.w0 = float(np.log(share / (1 - share)))
        gw, gv, g0 = np.full(self.w.shape, 1e-2, np.float32), np.full(self.v.shape, 1e-2, np.float32), 1e-2
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), batch):
                part = order[k : k + batch]
                ids, x = (np.concatenate(c) for c in zip(*(rows[i] for i in part), strict=True))
                sizes = np.array([len(rows[i][0]) for i in part])
                starts, doc = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(part)), sizes)
                vx = self.v[ids] * x[:, None]
                total = np.add.reduceat(vx, starts)
                z = self.w0 + np.add.reduceat(self.w[ids] * x, starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
                err = ((1 / (1 + np.exp(-z)) - y[part]) / len(part)).astype(np.float32)
                used, inverse = np.unique(ids, return_inverse=True)
                dw = np.bincount(inverse, err[doc] * x, len(used)).astype(np.float32) + decay * self.w[used]
                dv = np.zeros((len(used), self.v.shape[1]), np.float32)
                np.add.at(dv, inverse, (err[doc] * x)[:, None] * (total[doc] - vx))
                dv += decay * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                g0 += float(err.sum()) ** 2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])
                self.w0 -= rate * float(err.sum()) / np.sqrt(g0)


def train(sample: DataFrame, text: str = "text", n_chars: str = "n_chars") -> Machine | None:
    """Fit on every row of sample (column y); its features, bounded by the sample, come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Words()
        for b in batches:
            got = [features(t.as_py() or "", n, bucket) for t, n in zip(b.column(1), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([i for i, _, _ in got], pa.list_(pa.int32())), pa.array([x for _, x, _ in got], pa.list_(pa.float32())), pa.array([s for _, _, s in got], pa.list_(pa.float64()))], ["y", "ids", "x", "stats"])

    rows = sample.select("y", text, F.col(n_chars).cast("long")).mapInArrow(run, "y int, ids array<int>, x array<float>, stats array<double>").toArrow()
    if not rows.num_rows:
        return None
    ids, x, stats = ([v.values.to_numpy() for v in rows.column(c).combine_chunks()] for c in ("ids", "x", "stats"))
    y = rows.column("y").to_numpy().astype(np.float64)
    order = sorted(range(len(y)), key=lambda i: (y[i], len(ids[i]), tuple(stats[i])))  # the same model however rows arrive
    ids, x, stats, y = [ids[i] for i in order], [x[i] for i in order], [stats[i] for i in order], y[order]
    machine = Machine(np.quantile(np.array(stats), np.arange(1, BINS) / BINS, axis=0).T)
    machine.fit([machine.row(*r) for r in zip(ids, x, stats, strict=True)], y)
    return machine


def classify(docs: DataFrame, labels: DataFrame, may_learn: Column, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars", threshold: float = 0.3, bound: int = 4000) -> DataFrame:
    """key, score, predicted of every row; other columns are left out. At most `bound` labelled keys are learned from."""
    machine = train(labelled.sample(docs.select(key, text, n_chars), labels, "quality", may_learn, bound, key), text, n_chars)
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select(F.col(key), F.col(text), F.col(n_chars).cast("long").alias("n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, bucket = sent.value, Words()
        for b in batches:
            z = [model.raw(*model.row(*features(t.as_py() or "", n, bucket))) if model else 0.0 for t, n in zip(b.column(1), b.column(2).to_pylist(), strict=True)]
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], [key, "score", "predicted"])

    return rows.mapInArrow(run, f"{key} {rows.schema[0].dataType.simpleString()}, score double, predicted int")
