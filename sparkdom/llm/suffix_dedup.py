"""Repeated passages by a depth-limited radix sort of suffixes.

Suffixes are told apart through `width` bytes only, most significant digits first; what
is still together after the last digit are the windows of `width` bytes that occur more
than once. A suffix leaves the sort as soon as a digit leaves it alone.

Not every suffix is entered. In each window of `width` bytes the smallest hash among its
grams of GRAM bytes is its anchor, leftmost of equals; equal windows have equal anchors at
equal distances. So one entry stands for the run of neighbouring windows with the same
anchor, and the digits are

1. the anchor's gram: an anchor seen once has no repeated window. If all runs of an
   anchor are the same bytes, all their windows repeat and the run is done;
2. for the other runs (the edges of passages), blocks of BLOCK windows: first the bytes
   that all windows of the block have, then all bytes of the block;
3. single windows of the blocks that the second digit leaves open.

Every digit is a count by key with partial sums in each task, so a passage in a third of
all documents costs a row for each task. Keys are pairs of 64-bit hashes. Documents are
known by two hashes of their text: copies of a text share what is found.

`every_suffix` is the plain sort: all suffixes are entered and told apart by consecutive
digits of DIGIT bytes from their start. It finds the same, for many times the disk (see
the README), and takes any corpus that has that disk.

Defined cases: a null text is an empty one; texts under `width` bytes lose nothing;
repeated rows are copies like any other; the text left over drops the bytes of a
character that is cut in two; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdom.llm.common import drop_table, free_names, materialize, release, tidy

GRAM, BLOCK, DIGIT = 48, 12, 50
#: Bytes hashed at once; places in it take the low bits of a packed number.
PLACE_BITS = 18
CHUNK = 1 << PLACE_BITS
_state: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and powers of an odd base and of its inverse modulo 2^64."""
    if not _state:
        base = 0x9E3779B97F4A7C15
        _state["byte"] = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
        for name, b in (("power", base), ("back", pow(base, -1, 1 << 64))):
            p = np.full(CHUNK + 1, b, np.uint64)
            p[0] = 1
            _state[name] = np.multiply.accumulate(p)
    return _state["byte"], _state["power"], _state["back"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hashes:
    """Hashes of any stretch of a buffer of up to CHUNK bytes."""

    def __init__(self, buf: np.ndarray):
        byte, power, self.back = _tables()
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(byte[buf] * power[: len(buf)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    n = len(x) - w + 1
    pad = np.full(-len(x) % w, np.iinfo(np.uint64).max, np.uint64)
    rows = np.concatenate([x, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor, in the texts [starts, ends) of buf: text, anchor's place, first and last window, gram hash, run hash."""
    if len(buf) < width:
        return (np.array([], np.int64),) * 4 + (np.array([], np.uint64),) * 2
    hashes = Hashes(buf)
    at = np.arange(len(buf) - gram + 1)
    grams = hashes(at, at + gram)
    low = np.uint64(CHUNK - 1)
    best = (window_min((grams & ~low) | at.astype(np.uint64), width - gram + 1) & low).astype(np.int64)
    text = np.searchsorted(starts, np.arange(len(best)), "right") - 1
    first = np.flatnonzero((np.diff(best, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    last = np.append(first[1:], len(best)) - 1
    last = np.minimum(last, ends[text[first]] - width)  # windows stay inside their text
    ok = last >= first
    first, last = first[ok], last[ok]
    place = best[first]
    run = hashes(first, last + width)
    run = mix(run ^ mix(((place - first) << 16 | (place - last)).astype(np.uint64)))
    return text[first], place, first, last, grams[place], run


def pieces(texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of whole texts, or of overlapping parts of a long one: buffer, starts, ends, number of the text, place in it."""
    held, size = [], 0

    def packed() -> tuple[np.ndarray, ...]:
        ends = np.cumsum([len(p) for _, _, p in held])
        return np.frombuffer(b"".join(p for _, _, p in held), np.uint8), ends - [len(p) for _, _, p in held], ends, np.array([i for i, _, _ in held]), np.array([k for _, k, _ in held])

    step = CHUNK // 2
    for i, t in enumerate(texts):
        for k in range(0, max(len(t) - width + 1, 1), step):
            part = t[k : k + step + width - 1]
            if len(part) < width:
                continue
            if size + len(part) > CHUNK:
                yield packed()
                held, size = [], 0
            held.append((i, k, part))
            size += len(part)
    if held:
        yield packed()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _entries(docs: DataFrame, width: int) -> DataFrame:
    """t1, t2: the text; place: of the anchor; far, near: distance from the first and last window's start to it; a: gram; u: run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t1, t2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for buf, starts, ends, number, base in pieces([(t.as_py() or "").encode() for t in b.column(2)], width):
                text, place, first, last, a, u = anchors(buf, starts, ends, width, GRAM)
                doc = number[text]
                yield pa.RecordBatch.from_arrays([pa.array(t1[doc]), pa.array(t2[doc]), pa.array((place - starts[text] + base[text]).astype(np.int32)), pa.array((place - first).astype(np.int32)), pa.array((place - last).astype(np.int32)), _signed(a), _signed(u)], ["t1", "t2", "place", "far", "near", "a", "u"])

    return docs.select("t1", "t2", "text").mapInArrow(tidy(run), "t1 long, t2 long, place int, far int, near int, a long, u long")


def _contexts(packed: DataFrame, runs: DataFrame, width: int) -> tuple[DataFrame, str]:
    """a, u, n, far, near and the bytes of one run of each kind."""
    spark = packed.sparkSession
    lists, path = materialize(spark, runs.groupBy("t1", "t2").agg(F.collect_list(F.struct("a", "u", "n", "place", "far", "near")).alias("runs")), "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out: list[tuple] = []
            for blob, runs in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                text = z.decompress(blob.as_py())
                out += [(r["a"], r["u"], r["n"], r["far"], r["near"], text[r["place"] - r["far"] : r["place"] - r["near"] + width]) for r in runs]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["a", "u", "n", "far", "near", "bytes"])

    found = packed.join(lists, ["t1", "t2"]).select("blob", "runs").mapInArrow(tidy(run), "a long, u long, n long, far int, near int, bytes binary")
    return found.groupBy("a", "u").agg(F.first("n").alias("n"), F.first("far").alias("far"), F.first("near").alias("near"), F.first("bytes").alias("bytes")), path


def _joined(b: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray, Hashes]]:
    """Rows whose bytes fit in one buffer, where each begins, and the hashes of the buffer."""
    values = [v.as_py() for v in b.column(column)]
    size = np.cumsum([len(v) for v in values])
    s = 0
    while s < len(values):
        base = int(size[s - 1]) if s else 0
        e = max(s + 1, int(np.searchsorted(size, base + CHUNK, "right")))
        yield np.arange(s, e), np.concatenate([[0], size[s : e - 1] - base]).astype(np.int64), Hashes(np.frombuffer(b"".join(values[s:e]), np.uint8))
        s = e


def _blocks(contexts: DataFrame, width: int) -> DataFrame:
    """Second digit: a row for each block of each run: k, the bytes all its windows have; v, all its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, u, n, far, near = (b.column(k).to_numpy() for k in range(5))
            for rows, begins, hashes in _joined(b, 5):
                f, m = far[rows].astype(np.int64), near[rows].astype(np.int64)
                count = f // BLOCK - m // BLOCK + 1
                row = np.repeat(np.arange(len(rows)), count)
                block = np.repeat(m // BLOCK, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                place, lo, hi = (begins + f)[row], block * BLOCK, block * BLOCK + BLOCK - 1
                k = mix(hashes(place - lo, place - hi + width) ^ mix(block.astype(np.uint64)))
                whole = (lo >= m[row]) & (hi <= f[row])
                v = mix(u[rows][row].view(np.uint64) ^ block.astype(np.uint64))  # a part of a block is like no other
                v[whole] = hashes((place - hi)[whole], (place - lo + width)[whole])
                yield pa.RecordBatch.from_arrays([pa.array(a[rows][row]), pa.array(u[rows][row]), pa.array(n[rows][row]), pa.array(block.astype(np.int32)), _signed(k), _signed(v)], ["a", "u", "n", "block", "k", "v"])

    return contexts.mapInArrow(tidy(run), "a long, u long, n long, block int, k long, v long")


def _windows(contexts: DataFrame, width: int) -> DataFrame:
    """Third digit: a row for each window of the blocks listed in `blocks`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, u, n, far, near = (b.column(k).to_numpy() for k in range(5))
            lists = b.column(6).to_pylist()
            for rows, begins, hashes in _joined(b, 5):
                row = np.repeat(np.arange(len(rows)), [BLOCK * len(lists[r]) for r in rows])
                block = np.array([x for r in rows for x in lists[r]], np.int64)
                back = np.repeat(block * BLOCK, BLOCK) + np.tile(np.arange(BLOCK), len(block))
                ok = (back >= near[rows][row]) & (back <= far[rows][row])
                row, back = row[ok], back[ok]
                start = (begins + far[rows])[row] - back
                yield pa.RecordBatch.from_arrays([pa.array(a[rows][row]), pa.array(u[rows][row]), pa.array(n[rows][row]), pa.array(back.astype(np.int32)), _signed(hashes(start, start + width) ^ mix(back.astype(np.uint64)))], ["a", "u", "n", "back", "k"])

    return contexts.mapInArrow(tidy(run), "a long, u long, n long, back int, k long")


def _spans(edges: DataFrame, packed: DataFrame, width: int) -> tuple[DataFrame, list[str]]:
    """Covered stretches (t1, t2, s, e) of the runs whose anchor has different runs."""
    spark = edges.sparkSession
    kinds = edges.groupBy("a", "u").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "place", "far", "near")).alias("one")).select("a", "u", "n", "one.*")
    kinds, kinds_path = materialize(spark, kinds, "kinds")
    found, runs_path = _contexts(packed, kinds, width)
    contexts, contexts_path = materialize(spark, found, "contexts")
    blocks, blocks_path = materialize(spark, _blocks(contexts, width), "blocks")
    same, same_path = materialize(spark, blocks.groupBy("a", "k").agg(F.sum("n").alias("all"), F.min("v").alias("v0"), F.max("v").alias("v1")).where("all >= 2"), "same")
    live, live_path = materialize(spark, blocks.join(same, ["a", "k"]).select("a", "u", "block", (F.col("v0") == F.col("v1")).alias("done")), "live")
    open_blocks = live.where(~F.col("done")).groupBy("a", "u").agg(F.collect_list("block").alias("blocks"))
    single, single_path = materialize(spark, _windows(contexts.join(open_blocks, ["a", "u"]).select("a", "u", "n", "far", "near", "bytes", "blocks"), width), "windows")
    twice, twice_path = materialize(spark, single.groupBy("a", "k").agg(F.sum("n").alias("all")).where("all >= 2").select("a", "k"), "twice")
    hits = single.join(twice, ["a", "k"]).select("a", "u", F.col("back").alias("lo"), F.col("back").alias("hi"))
    hits = hits.union(live.where("done").select("a", "u", (F.col("block") * BLOCK).alias("lo"), (F.col("block") * BLOCK + BLOCK - 1).alias("hi")))
    alone = kinds.where("n = 1").join(hits, ["a", "u"]).select("t1", "t2", (F.col("place") - F.col("hi")).alias("s"), (F.col("place") - F.col("lo") + width).alias("e"))
    several = edges.join(kinds.where("n >= 2").select("a", "u"), ["a", "u"]).select("t1", "t2", (F.col("place") - F.col("far")).alias("s"), (F.col("place") - F.col("near") + width).alias("e"))
    return alone.union(several), [kinds_path, runs_path, contexts_path, blocks_path, same_path, live_path, single_path, twice_path]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal covered stretches."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _sorted(hashed: DataFrame, width: int) -> DataFrame:
    """Covered stretches (t1, t2, s, e), by a most-significant-digit sort of every suffix of at least `width` bytes."""
    spark = hashed.sparkSession
    ends = [*range(DIGIT, width, DIGIT), width]
    digits = [f"d{k}" for k in range(len(ends))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t1, t2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for buf, starts, last, number, base in pieces([(t.as_py() or "").encode() for t in b.column(2)], width):
                hashes = Hashes(buf)
                at = np.arange(max(len(buf) - width + 1, 0))
                part = np.searchsorted(starts, at, "right") - 1
                at = at[at + width <= last[part]]
                part = np.searchsorted(starts, at, "right") - 1
                doc = number[part]
                # the hash of a digit covers those before it: equal ones are one group of the sort
                yield pa.RecordBatch.from_arrays([pa.array(t1[doc]), pa.array(t2[doc]), pa.array((at - starts[part] + base[part]).astype(np.int32)), *(_signed(hashes(at, at + e)) for e in ends)], ["t1", "t2", "place", *digits])

    live = hashed.select("t1", "t2", "text").mapInArrow(tidy(run), "t1 long, t2 long, place int" + "".join(f", {d} long" for d in digits))
    live, path = materialize(spark, live, "suffixes")
    for k, d in enumerate(digits):
        twice, twice_path = materialize(spark, live.groupBy(d).agg(F.count("*").alias("n")).where("n > 1").select(d), "digit")
        rest, rest_path = materialize(spark, live.join(twice, d, "left_semi").select("t1", "t2", "place", *digits[k + 1 :]), "suffixes")
        drop_table(spark, path)
        drop_table(spark, twice_path)
        live, path = rest, rest_path
    return live.select("t1", "t2", F.col("place").alias("s"), (F.col("place") + width).alias("e"))


def covered(docs: DataFrame, text: str = "text", width: int = 200, every_suffix: bool = False) -> DataFrame:
    """The stretches to remove of each text: t1, t2, spans."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    hashed = docs.select(F.xxhash64(whole).alias("t1"), F.xxhash64(F.lit(1), whole).alias("t2"), whole.alias("text"))
    if every_suffix:
        lists, _ = materialize(spark, _sorted(hashed, width).groupBy("t1", "t2").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "spans")
        return lists

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([z.compress(t.as_py().encode()) for t in b.column(2)], pa.binary())], ["t1", "t2", "blob"])

    packed = hashed.mapInArrow(tidy(pack), "t1 long, t2 long, blob binary")
    entries, entries_path = materialize(spark, _entries(hashed, width), "suffixes")
    # counts are written first: the join then deals both sides anew, and Spark can split a frequent anchor
    same, same_path = materialize(spark, entries.groupBy("a").agg(F.count("*").alias("all"), F.min("u").alias("u0"), F.max("u").alias("u1")).where("all >= 2"), "anchors")
    met, met_path = materialize(spark, entries.join(same, "a").select(*entries.columns, (F.col("u0") == F.col("u1")).alias("done")), "met")
    del entries, same
    drop_table(spark, entries_path)
    drop_table(spark, same_path)
    release(spark)
    rest, paths = _spans(met.where(~F.col("done")), packed, width)
    spans = met.where("done").select("t1", "t2", (F.col("place") - F.col("far")).alias("s"), (F.col("place") - F.col("near") + width).alias("e")).union(rest)
    lists, _ = materialize(spark, spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "spans")
    for p in [met_path, *paths]:
        drop_table(spark, p)
    del spans, rest, met
    release(spark)
    return lists


def remove(docs: DataFrame, text: str = "text", width: int = 200, keep_text: bool = False, key: str = "doc_id", every_suffix: bool = False) -> DataFrame:
    """Bytes covered by a window of `width` bytes that also starts anywhere else are taken out.

    By default key, n_bytes, n_removed, n_spans, kept_sha256 of every row; with keep_text all
    columns of docs, its text replaced by what is left.
    """
    lists = covered(docs, text, width, every_suffix)
    whole = F.coalesce(F.col(text), F.lit(""))
    others = [c for c in docs.columns if c != text] if keep_text else [key]
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    t1, t2, body, blob, found = free_names(docs.columns, "t1", "t2", "body", "blob", "spans")
    held = docs.select(F.xxhash64(whole).alias(t1), F.xxhash64(F.lit(1), whole).alias(t2), *[docs[f"`{c}`"] for c in others], F.col(text).alias(body))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(3)
        for b in batches:
            blobs = [z.compress(t.as_py().encode()) if t.is_valid else None for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(blobs, pa.binary())], [*b.schema.names[:-1], blob])

    kept_fields = ", ".join(f"`{c}` {fields[c]}" for c in others)
    packed = held.mapInArrow(tidy(pack), f"{t1} long, {t2} long, {kept_fields}, {blob} binary")
    lists = lists.select(F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("spans").alias(found))
    rows = packed.join(lists, [t1, t2], "left").select(*[f"`{c}`" for c in others], blob, found)
    k = len(others)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            left, sizes, gone, counts, shas = [], [], [], [], []
            for packed_text, spans in zip(b.column(k), b.column(k + 1), strict=True):
                raw = z.decompress(packed_text.as_py()) if packed_text.is_valid else b""
                stretches = merge([(x["s"], x["e"]) for x in spans.as_py()]) if spans.is_valid else []
                edges = [0, *(p for s in stretches for p in s), len(raw)]
                kept = b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
                if keep_text:
                    left.append(kept.decode("utf-8", "ignore") if packed_text.is_valid else None)
                    continue
                sizes.append(len(raw))
                gone.append(len(raw) - len(kept))
                counts.append(len(stretches))
                shas.append(hashlib.sha256(kept).hexdigest())
            if keep_text:
                yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(left, pa.string())], [*others, text])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(counts, pa.int64()), pa.array(shas, pa.string())], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    if keep_text:
        return rows.mapInArrow(tidy(cut), f"{kept_fields}, `{text}` string").select(*[f"`{c}`" for c in docs.columns])
    return rows.mapInArrow(tidy(cut), f"{kept_fields}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
