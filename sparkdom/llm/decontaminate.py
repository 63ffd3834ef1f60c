"""Benchmark decontamination by edit distance.

Texts and items are words, lower-cased; an item leaks where some stretch of a document is
within floor((1 - similarity) * words of the item) word edits of it.

1. Windows as long as an item are looked at where they hold enough of its word pairs: an
   edit undoes two pairs at most, so no leak is lost here.
2. CGK: a random walk over window and item, with a random bit for each step and word
   that says whether to move on, maps few edits to few differing places.
3. Bit sampling: tables keyed by a few sampled places of the walk. There are as many
   tables as the target recall needs for the worst of the items that were edited in trial.
   Lengths for which that is over MOST_TABLES, and items of many thousand words, take no
   tables: all that the pairs leave, which is complete, is verified.
4. What collides is verified by the exact edit distance (Myers' bit-parallel search).

The tables are built once, on the driver, and broadcast; a walk's bits are hashes of
table, step and word, so they take no memory. `similarity` is 0.75 at least: below that
the pairs of a short item would prove nothing.

Defined cases: null texts and items are empty; an item without words never leaks; items
under five words must appear as they are; repeated documents are judged each for itself;
of an item's several places in a document the closest and then the first counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkdom.llm.common import tidy

WORD = re.compile(r"[^\W_]+")
#: Words scanned at once; bytes of item texts that one pass takes; most tables of a length, and of tables times words; numbers held for windows at once.
CHUNK, PASS_BYTES, MOST_TABLES, MOST_WORK, HELD = 1 << 19, 2 << 20, 96, 1 << 16, 1 << 22
#: Items edited to measure collisions, and tables that each of them is tried on.
TRIALS, TRIAL_TABLES = 24, 48
PAIR_BITS, LEAST_SIMILARITY = 20, 0.75


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def edits(n: int, similarity: float) -> int:
    return math.floor((1 - similarity) * n + 1e-9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Walk:
    """CGK walks of one length. A step's bit is a hash of table, step and word."""

    def __init__(self, n: int, tables: int, places: int, seed: int):
        rng = np.random.default_rng(seed)
        self.n, self.steps, self.seed = n, 3 * n, seed
        share = rng.random((tables, places))
        self.sampled = np.sort((share * self.steps).astype(np.int64), 1)
        self.salt = rng.integers(1, 1 << 62, places, np.int64) | 1

    def keys(self, x: np.ndarray) -> np.ndarray:
        """A key for each table and row of words."""
        tables, places = self.sampled.shape
        flat = np.concatenate([x, np.full((len(x), 1), -1, x.dtype)], 1).ravel()
        start = (np.arange(len(x)) * (self.n + 1))[None, :]
        at, out = np.zeros((tables, len(x)), np.int64), np.zeros((tables, len(x)), np.int64)
        wanted: dict[int, list[tuple[int, int]]] = {}
        for t in range(tables):
            for k, j in enumerate(self.sampled[t].tolist()):
                wanted.setdefault(j, []).append((t, k))
        table = (np.arange(tables, dtype=np.uint64) << np.uint64(32))[:, None] + np.uint64(self.seed << 48)
        for j in range(max(wanted, default=-1) + 1):
            if not j % 256:
                odd = mix(table + np.arange(j, j + 256, dtype=np.uint64)) | np.uint64(1)
            symbol = flat[start + at]
            for t, k in wanted.get(j, ()):
                out[t] += (symbol[t].astype(np.int64) + 2) * self.salt[k]
            moved = ((symbol.astype(np.uint64) + np.uint64(2)) * odd[:, j % 256, None]) >> np.uint64(63)
            at = np.minimum(at + moved.astype(np.int64), self.n)
        return out


def best_match(item: dict[int, int], n: int, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of text, and where the first such stretch ends. item: bit masks of its words."""
    full = (1 << n) - 1
    plus, minus, score = full, 0, n
    best, end = n, 0
    top = 1 << (n - 1)
    for j, w in enumerate(text.tolist()):
        eq = item.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | (full & ~(xh | plus)), plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus, minus = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Detector:
    def __init__(self, items: list[tuple[int, str]], similarity: float = 0.8, recall: float = 0.99, places: int = 2, seed: int = 11):
        if similarity < LEAST_SIMILARITY:
            raise ValueError(f"similarity must be {LEAST_SIMILARITY} at least")
        rng = np.random.default_rng(seed)
        split = [(i, words_of(t)) for i, t in items]
        self.ids: dict[str, int] = {}
        rows = [(i, [self.ids.setdefault(w, len(self.ids) + 1) for w in ws]) for i, ws in split if ws]
        self.base = len(self.ids) + 1
        self.similarity = similarity
        self.items, self.lengths = [i for i, _ in rows], sorted({len(w) for _, w in rows})
        self.size = np.array([len(w) for _, w in rows], np.int64)
        self.row = np.zeros(len(rows), np.int64)
        self.members = {n: [] for n in self.lengths}
        for k, (_, w) in enumerate(rows):
            self.row[k] = len(self.members[len(w)])
            self.members[len(w)].append(k)
        self.members = {n: np.array(m) for n, m in self.members.items()}
        self.matrix = {n: np.array([rows[k][1] for k in m], np.int32) for n, m in self.members.items()}
        self.pairs = {n: np.unique(x[:, :-1].astype(np.int64) * self.base + x[:, 1:]) for n, x in self.matrix.items()}
        self.bits = max(PAIR_BITS, int(sum(map(len, self.pairs.values())) * 16).bit_length())
        self.known = np.zeros(1 << self.bits, bool)
        for p in self.pairs.values():
            self.known[self._slot(p)] = True
        self.bands: list[list[int]] = []
        for n in self.lengths:
            if self.bands and n > 4 and self.bands[-1][0] > 4 and n <= 1.25 * self.bands[-1][0]:
                self.bands[-1].append(n)
            else:
                self.bands.append([n])
        self.reach = max((n + edits(n, similarity) for n in self.lengths), default=0) + 1
        self.walks, self.tables, self.posts = {}, {}, {}
        self.masks: dict[int, tuple[dict, dict]] = {}
        for band in self.bands:
            tables = self._tables(band[-1], self.matrix[band[-1]], recall, places, rng)
            for n in band:
                self.posts[n] = self._postings(n)
                if tables > MOST_TABLES or n * tables > MOST_WORK:
                    continue
                self.walks[n] = Walk(n, tables, places, seed)
                keys = np.concatenate([self.walks[n].keys(p) for p in self._parts(n, self.matrix[n], tables)], 1)
                order = np.argsort(keys, 1, kind="stable")
                self.tables[n] = np.take_along_axis(keys, order, 1), self.members[n][order].astype(np.int32)

    @staticmethod
    def _parts(n: int, x: np.ndarray, tables: int) -> Iterator[np.ndarray]:
        step = max(1, HELD // max(n, 4 * tables))
        for s in range(0, len(x), step):
            yield x[s : s + step]

    def _tables(self, n: int, x: np.ndarray, recall: float, places: int, rng: np.random.Generator) -> int:
        """Tables that the least often met of some items takes, with as many edits as are allowed."""
        k = edits(n, self.similarity)
        if not k or n > MOST_WORK // 4:
            return 1 if not k else MOST_TABLES + 1
        some = x[rng.integers(0, len(x), TRIALS)]
        changed = np.array([self._edited(r, k, rng) for r in some], np.int32)
        trial = Walk(n, TRIAL_TABLES, places, 1)
        met = (trial.keys(some) == trial.keys(changed)).sum(0).min()
        p = (met + 0.5) / (TRIAL_TABLES + 1)
        return max(4, math.ceil(math.log(1 - recall) / math.log(1 - p)))

    def _postings(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the items of n words, sorted, with the items that hold them."""
        x = self.matrix[n]
        both = np.unique(np.stack([(x[:, :-1].astype(np.int64) * self.base + x[:, 1:]).ravel(), np.repeat(self.members[n], n - 1)], 1), axis=0)
        return both[:, 0], both[:, 1]

    @staticmethod
    def _edited(row: np.ndarray, k: int, rng: np.random.Generator) -> list[int]:
        out = row.tolist()
        for _ in range(k):
            at, kind = int(rng.integers(0, max(len(out), 1))), rng.integers(0, 3)
            if kind == 0:
                out[at : at + 1] = [0]
            elif kind == 1:
                del out[at : at + 1]
            else:
                out.insert(at, 0)
        return (out + [0] * len(row))[: len(row)]

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return (mix(pairs.astype(np.uint64)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def need(self, n: int) -> int:
        return n - 1 - 2 * edits(n, self.similarity)

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (number of the item, distance, first word, end word) of each item that leaks."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        held, size = [], 0
        for i, t in enumerate(texts):
            words = words_of(t)
            held.append((i, np.fromiter(map(self.ids.get, words, repeat(0)), np.int32, len(words))))
            size += len(words)
            if size >= CHUNK:
                self._scan(held, out)
                held, size = [], 0
        self._scan(held, out)
        return out

    def _scan(self, held: list[tuple[int, np.ndarray]], out: list) -> None:
        if not held or not self.lengths:
            return
        # a word that no item has ends a text: no pair reaches over it, and verification stays inside
        gap = np.zeros(1, np.int32)
        ids = np.concatenate([*(p for _, w in held for p in (w, gap)), np.zeros(self.reach, np.int32)])
        size = np.array([len(w) + 1 for _, w in held])
        starts = np.cumsum(size) - size
        pair = ids[:-1].astype(np.int64) * self.base + ids[1:]
        seen = self.known[self._slot(pair)] & (ids[:-1] > 0) & (ids[1:] > 0)
        total = np.zeros(len(ids), np.int32)
        np.cumsum(seen, dtype=np.int32, out=total[1:])
        last = len(ids) - self.reach
        hits = []
        for band in self.bands:
            if band[0] == 1:
                active = np.flatnonzero(np.isin(ids[:last], self.matrix[1]))
                hits += self._collide(ids, active, 1)
                continue
            width = max(n + edits(n, self.similarity) for n in band) - 1
            active = np.flatnonzero(total[width : width + last] - total[:last] >= min(map(self.need, band)))
            if not len(active):
                continue
            # the places that an active window covers
            far = np.maximum.accumulate(active + width)
            fresh = np.maximum(active, np.concatenate([[0], far[:-1]]))
            count = far - fresh
            at = np.repeat(fresh, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            where = np.searchsorted(at, active)
            for n in band:
                own, reach = self.pairs[n], n + edits(n, self.similarity) - 1
                slot = np.searchsorted(own, pair[at]).clip(max=len(own) - 1)
                below = np.concatenate([[0], np.cumsum(own[slot] == pair[at])])
                some = active[below[where + reach] - below[where] >= self.need(n)]
                shared = list(self._shared(pair, some, n))
                if n not in self.walks:
                    hits += shared
                elif shared:
                    # windows that begin where an item's pairs do, or as far before as edits can move that
                    first = np.unique(np.concatenate([p for p, _ in shared]))
                    next_one = first[np.searchsorted(first, some).clip(max=len(first) - 1)]
                    hits += self._collide(ids, some[(next_one >= some) & (next_one <= some + 3 * edits(n, self.similarity))], n)
        if hits:
            self._verify(held, ids, starts, np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits]), out)

    def _collide(self, ids: np.ndarray, active: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts of windows, and items that share a table's key with them."""
        held, items = self.tables[n]
        for part in self._parts(n, active, len(held)):
            got = self.walks[n].keys(ids[part[:, None] + np.arange(n)])
            found = []
            for t, keys in enumerate(held):
                lo = np.searchsorted(keys, got[t], "left")
                count = np.searchsorted(keys, got[t], "right") - lo
                row = np.repeat(np.arange(len(part)), count)
                found.append(row * len(self.items) + items[t][np.repeat(lo, count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)])
            pairs = np.unique(np.concatenate(found))
            if len(pairs):
                yield part[pairs // len(self.items)], pairs % len(self.items)

    def _shared(self, pair: np.ndarray, active: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts, and the items that have enough pairs from there on: complete, without tables."""
        if not len(active):
            return
        reach, need = n + edits(n, self.similarity) - 1, self.need(n)
        far = np.maximum.accumulate(active + reach)
        fresh = np.maximum(active, np.concatenate([[0], far[:-1]]))
        at = np.concatenate([np.arange(f, e) for f, e in zip(fresh.tolist(), far.tolist(), strict=True)])
        keys, items = self.posts[n]
        for s in range(0, len(at), CHUNK):  # parts overlap by a window
            part = at[s : s + CHUNK + reach]
            lo = np.searchsorted(keys, pair[part], "left")
            count = np.searchsorted(keys, pair[part], "right") - lo
            item = items[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            place = np.repeat(part, count)
            order = np.lexsort((place, item))
            item, place = item[order], place[order]
            first = np.arange(max(len(item) - need + 1, 0))
            ok = (item[first] == item[first + need - 1]) & (place[first + need - 1] - place[first] < reach)
            if ok.any():
                yield place[first[ok]], item[first[ok]]

    def _verify(self, held: list, ids: np.ndarray, starts: np.ndarray, at: np.ndarray, item: np.ndarray, out: list) -> None:
        doc = np.searchsorted(starts, at, "right") - 1
        order = np.lexsort((at, item, doc))
        at, item, doc = at[order], item[order], doc[order]
        # starts that lie within an item's length of each other share one search
        length = self.size
        cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(at) > length[item[1:]])) + 1
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for f, e in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
            key = d, i = int(doc[f]), int(item[f])
            n = int(length[i])
            k, begin, size = edits(n, self.similarity), int(starts[d]), len(held[d][1])
            # words before the first pair that is left: at most two for each edit, and what was put in
            lo, hi = max(begin, int(at[f]) - 3 * k), min(begin + size, int(at[e - 1]) + n + 2 * k)
            if best.get(key, (1,))[0] == 0:
                continue
            if i not in self.masks:
                words = self.matrix[n][self.row[i]].tolist()
                self.masks[i] = masks(words), masks(words[::-1])
            forward, backward = self.masks[i]
            distance, end = best_match(forward, n, ids[lo:hi])
            if distance <= k:
                back, reach = best_match(backward, n, ids[lo : lo + end][::-1][: n + k])
                best[key] = min(best.get(key, (n, 0, 0)), (distance, lo + end - (reach if back == distance else n) - begin, lo + end - begin))
        for (doc, item), (distance, first, end) in sorted(best.items()):
            out[held[doc][0]].append((item, distance, first, end))


def _passes(items: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """The items, in lists of PASS_BYTES of text at most (or one longer item)."""
    held, size = [], 0
    for r in items.select(key, text).orderBy(key, text).toLocalIterator():
        n = len((r[1] or "").encode())
        if held and size + n > PASS_BYTES:
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += n
    if held:
        yield held


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """key, item_id, distance, n_words (of the item), first_word, end_word: a row for each document and item that leaks into it."""
    spark, rows = docs.sparkSession, docs.select(key, text)
    kind = rows.schema[0].dataType.simpleString()
    item_kind = items.schema[item_key].dataType.simpleString()
    found: DataFrame | None = None
    for part in _passes(items, item_key, item_text):
        sent = spark.sparkContext.broadcast(Detector(part, similarity, recall))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            detector = sent.value
            for b in batches:
                got = [(i, *m) for i, found in enumerate(detector.scan(b.column(1).to_pylist())) for m in found]
                if got:
                    doc, item, distance, first, end = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array([detector.items[k] for k in item]), pa.array(distance, pa.int32()), pa.array(detector.size[list(item)], pa.int32()), pa.array(first, pa.int32()), pa.array(end, pa.int32())], [key, "item_id", "distance", "n_words", "first_word", "end_word"])

        one = rows.mapInArrow(tidy(run), f"{key} {kind}, item_id {item_kind}, distance int, n_words int, first_word int, end_word int")
        found = one if found is None else found.unionByName(one)
    return found if found is not None else spark.createDataFrame([], f"{key} {kind}, item_id {item_kind}, distance int, n_words int, first_word int, end_word int")


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """docs without the rows that an item leaks into."""
    at = docs.columns.index(text)
    for part in _passes(items, item_key, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(Detector(part, similarity, recall))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            detector = sent.value
            for b in batches:
                yield b.filter(pa.array([not m for m in detector.scan(b.column(at).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
