"""Language identification by prediction by partial matching.

Each language gets a byte context tree of order 0 to 3 with escape probabilities (method
C, with exclusion), counted on a sample and then frozen. A text's code length under each
tree is exact: with frozen statistics the cost of a byte depends on it and the three
bytes before it alone, so every different four bytes of a buffer are priced once.

What is seen after a context is seen after its shorter contexts too. So what is excluded
in a context is what its next longer one has, and a context needs two numbers for its
shorter one: how much is left there, and what leaving it costs. A tree is sorted arrays
of what was seen, for each order; nothing is cut from it.

The trees are broadcast in groups of languages of GROUP_BYTES; texts take a pass for
each group, and carry the best so far along.

Defined cases: `und` with score 0 for a null text and one without a letter; an empty
training set makes every text `und`; ties go to the language first in the alphabet;
null languages are not learned; a language whose texts are all empty costs 8 bits a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdom.llm.common import MAX_BROADCAST_BYTES, drop_table, materialize

LETTER = regex.compile(r"\p{L}")
#: Bytes priced at once, and the history that a text begins with.
SLICE, START = 4 << 20, b"\n\n\n"


def _grams(text: bytes) -> np.ndarray:
    b = np.frombuffer(START + text, np.uint8).astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


def count_grams(df: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, gram (four bytes as a number), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}

        def squeeze(name: str) -> None:
            if total[name]:
                codes, counts = (np.concatenate(x) for x in zip(*total[name], strict=True))
                keys, inverse = np.unique(codes, return_inverse=True)
                total[name] = [(keys, np.bincount(inverse, counts, len(keys)).astype(np.int64))]
                sizes[name] = 0

        for b in batches:
            for t, name in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                codes, counts = np.unique(_grams((t.as_py() or "").encode()), return_counts=True)
                total.setdefault(name, []).append((codes, counts))
                sizes[name] = sizes.get(name, 0) + len(codes)
                if sizes[name] > 1 << 21:
                    squeeze(name)
        for name in total:
            squeeze(name)
            codes, counts = total[name][0]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    return df.select(text, lang).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key is, and whether it is there at all."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted).clip(max=len(keys) - 1)
    return at, keys[at] == wanted


class FrozenTree:
    """Costs in bits of one language. Contexts and context-and-byte keys are numbers, the last byte lowest."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        grams = grams.astype(np.uint32)
        self.keys, self.bits, self.contexts, self.own, self.leave = [], [], [], [], []
        self.left, self.leave_left = [None], [None]
        before = None
        for order in range(4):
            keys, at = np.unique(grams & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
            n = np.bincount(at, counts, len(keys)).astype(np.float64)
            contexts, of = np.unique(keys >> np.uint32(8), return_inverse=True)
            total, kinds = np.bincount(of, n, len(contexts)), np.bincount(of, minlength=len(contexts)).astype(np.float64)
            self.keys.append(keys)
            self.bits.append(np.log2(n))
            self.contexts.append(contexts)
            self.own.append(np.log2(total + kinds))
            self.leave.append(np.log2(total + kinds) - np.log2(kinds))
            if order:
                # what the shorter context has besides
                low = np.uint32((1 << 8 * order) - 1)
                up, _ = _find(self.contexts[order - 1], contexts & (low >> np.uint32(8)))
                same, _ = _find(self.keys[order - 1], keys & low)
                rest = before[1][up] - np.bincount(of, before[0][same], len(contexts))
                more = before[2][up] - kinds
                some = more > 0
                left = np.log2(np.where(some, rest + more, 1))
                self.left.append(left)
                self.leave_left.append(np.where(some, left - np.log2(np.where(some, more, 1)), 0.0))
            before = n, total, kinds
        self.new = float(np.log2(max(256 - len(self.keys[0]), 1)))

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for part in (self.keys, self.bits, self.contexts, self.own, self.leave, self.left, self.leave_left) for a in part if a is not None)

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """Bits of each gram's last byte after its first three."""
        out, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
        deeper, at_deeper = np.zeros(len(grams), bool), np.zeros(len(grams), np.int64)
        for order in (3, 2, 1, 0):
            keys = grams & np.uint32((1 << 8 * (order + 1)) - 1)
            at, known = _find(self.contexts[order], keys >> np.uint32(8))
            where, found = _find(self.keys[order], keys)
            if not len(self.contexts[order]):
                continue
            whole, leave = self.own[order][at], self.leave[order][at]
            if order < 3 and len(self.contexts[order + 1]):
                whole = np.where(deeper, self.left[order + 1][at_deeper], whole)
                leave = np.where(deeper, self.leave_left[order + 1][at_deeper], leave)
            now = open_ & found
            out[now] += whole[now] - self.bits[order][where[now]]
            open_ &= ~found
            go = open_ & known
            out[go] += leave[go]
            deeper, at_deeper = known, at
        out[open_] += self.new
        return out


def code_lengths(trees: list[FrozenTree], texts: list[bytes]) -> np.ndarray:
    """Bits of each text under each tree."""
    out = np.zeros((len(texts), len(trees)))
    held: list[tuple[int, bytes]] = []
    size = 0

    def price() -> None:
        which = np.array([i for i, _ in held], np.int64)
        ends = np.cumsum([len(x) for _, x in held])
        b = np.frombuffer(b"".join(x for _, x in held), np.uint8).astype(np.uint32)
        coded = pa.array((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]).dictionary_encode()
        grams, at = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        # sums over the grams of each part; the three that reach into the next part are left out
        bounds = np.stack([ends - [len(x) for _, x in held], ends - 3], 1).ravel()
        for k, tree in enumerate(trees):
            bits = np.append(tree.cost(grams)[at], 0.0)
            np.add.at(out[:, k], which, np.add.reduceat(bits, bounds)[::2])

    for i, t in enumerate(texts):
        for k in range(0, len(t), SLICE):
            held.append((i, (START + t[:SLICE]) if not k else t[k - 3 : k + SLICE]))
            size += len(held[-1][1])
            if size >= SLICE:
                price()
                held, size = [], 0
    if held:
        price()
    return out


def sample(df: DataFrame, keep: Column, lang: str, key: str, docs_per_lang: int) -> DataFrame:
    """About docs_per_lang rows of each language, chosen by a hash of the key."""
    rows = df.where(keep & F.col(lang).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col(lang) == name, min(1.0, docs_per_lang / n)).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20)) < share * (1 << 20))


def _groups(spark, grams: DataFrame, langs: list[str], most: int) -> Iterator[list[tuple[str, FrozenTree]]]:
    """Trees in the order of langs, in lists of `most` bytes at most (or one larger tree)."""
    held: list[tuple[str, FrozenTree]] = []
    size = 0
    for name in langs:
        got = grams.where(F.col("lang") == name).select("gram", "n").toArrow()
        tree = FrozenTree(got.column("gram").to_numpy(), got.column("n").to_numpy())
        if held and size + tree.nbytes > most:
            yield held
            held, size = [], 0
        held.append((name, tree))
        size += tree.nbytes
    if held:
        yield held


def identify(df: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_lang: int = 400, group_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """key, lang_pred, score of every row; other columns are left out.

    train says which rows may be learned from; about docs_per_lang of each language are, in whole.
    score is the share of the likeliest language, from the code lengths.
    """
    spark = df.sparkSession
    learned = sample(df, train, lang, key, docs_per_lang)
    grams, path = materialize(spark, count_grams(learned, text, lang).repartition("lang"), "grams")
    # a language of empty texts has no grams
    langs = sorted({r[0] for r in learned.select(lang).distinct().collect()})
    kind = df.select(key).schema[0].dataType.simpleString()
    schema = "id " + kind + ", text string, lang_pred string, bits double, share double"
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"), F.lit("und").alias("lang_pred"), F.lit(float("inf")).alias("bits"), F.lit(0.0).alias("share"))
    last = None
    for group in _groups(spark, grams, langs, group_bytes):
        if last is not None:  # a pass of its own: two groups are never held by the workers of one task
            before = last
            rows, last = materialize(spark, rows, "lang-pass")
            if before:
                drop_table(spark, before)
        else:
            last = ""
        sent = spark.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, trees = [n for n, _ in sent.value], [t for _, t in sent.value]
            for b in batches:
                texts = [t.as_py() or "" for t in b.column(1)]
                known = np.array([bool(LETTER.search(t)) for t in texts])
                best, top, share = b.column(2).to_pylist(), b.column(3).to_numpy().copy(), b.column(4).to_numpy().copy()
                here = code_lengths(trees, [t.encode() if k else b"" for t, k in zip(texts, known, strict=True)])
                won = here.argmin(1)
                low = here[np.arange(len(texts)), won]
                for i in np.flatnonzero(known & (low < top)):
                    best[i] = names[won[i]]
                new = np.where(known, np.minimum(low, top), top)
                # share: the sum of all odds against the best so far
                odds = lambda bits: np.exp2(-np.clip(bits, 0, 1000))
                with np.errstate(invalid="ignore"):
                    carried = np.where(np.isfinite(top), share * odds(top - new), 0.0)
                    share = np.where(known, carried + odds(here - new[:, None]).sum(1), 0.0)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best), pa.array(new), pa.array(share)], ["id", "text", "lang_pred", "bits", "share"])

        rows = rows.mapInArrow(run, schema)
    drop_table(spark, path)
    return rows.select(F.col("id").alias(key), "lang_pred", F.when(F.col("share") > 0, 1 / F.col("share")).otherwise(0.0).alias("score"))
