"""SimHash near-duplicates through deletion-variant signatures.

Two fingerprints within k bits agree, in at least one of floor(k / 2) + 1 segments, to
within one bit. So every fingerprint is entered once for each bit of each segment, with
that bit deleted from its segment; fingerprints that share such a variant are verified.
What is passed on from a variant's group is a star over its verified links, never their
pairs, and components are found on those.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other;
a text of fewer words than a shingle is one shingle; null ids take no part in choosing
the smallest id, and a component of null ids alone has a null component_id; repeated rows
each keep their row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdom.llm.common import drop_table, materialize, tidy
from sparkdom.llm.components import components, stars

#: Shingle hashes counted at once; group size up to which all members are compared.
SLICE, GROUP = 1 << 16, 2048


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles, repeats included; a bit is 1 if over half the hashes have it."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    ones, n = np.zeros(64, np.int64), max(len(w) - words + 1, 1)
    for k in range(0, n, SLICE):
        part = w[k : k + SLICE + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
        ones += _ones(np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], np.uint64))
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def of_hashes(hashes: np.ndarray) -> int:
    """64-bit SimHash of shingles that are hashed already; of none it is zero."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), SLICE):
        ones += _ones(hashes[k : k + SLICE])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, key: str, text: str, words: int = 4, seed: int = 42) -> DataFrame:
    """id, text_hash, fp of every row."""
    rows = df.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([fingerprint(t.as_py(), words, seed) for t in b.column(2)], pa.int64())], ["id", "text_hash", "fp"])

    return rows.mapInArrow(tidy(run), f"id {rows.schema[0].dataType.simpleString()}, text_hash long, fp long")


def segments(k: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of the fewest segments of which one differs by at most one bit when k bits differ in all."""
    m = k // 2 + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def variants(fp: Column, k: int) -> Column:
    """One number for every deleted bit: which bit, above what is left of its segment."""
    out = []
    for low, bits in segments(k):
        part = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1))
        out += [part.bitwiseAND(F.lit(((1 << bits) - 1) ^ (1 << j))).bitwiseOR(F.lit((low + j) << 40)) for j in range(bits)]
    return F.array(*out)


def group_links(fps: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    """Links that connect what lies within k bits, in one group of distinct fingerprints; a spanning star for each cluster."""
    if len(fps) > GROUP:
        # of k + 1 pieces one is equal: smaller groups, and none is left out
        us, vs = [], []
        cuts = [64 * i // (k + 1) for i in range(k + 2)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            piece = (fps >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
            order = np.argsort(piece, kind="stable")
            for part in np.split(fps[order], np.flatnonzero(np.diff(piece[order])) + 1):
                if len(part) > 1:
                    got = _clusters(part, k)
                    us += got[0]
                    vs += got[1]
        return us, vs
    return _clusters(fps, k)


def _clusters(fps: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    """Walk from a fingerprint to those within k bits of it that no walk has reached."""
    left, us, vs = fps, [], []
    if len(left) == 2:  # most groups
        a, b = left.tolist()
        return ([a], [b]) if (a ^ b).bit_count() <= k else ([], [])
    while len(left) > 1:
        root, frontier, left = left[0], [left[0]], left[1:]
        while frontier and len(left):
            near = np.bitwise_count(left ^ frontier.pop()) <= k
            if near.any():
                got = left[near]
                frontier += list(got)
                us += got.tolist()
                vs += [int(root)] * len(got)
                left = left[~near]
    return us, vs


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Fingerprints (first column) of rows that are next to each other with the same second column."""
    held_key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        fps, keys = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
        first = 0
        if held_key is not None and keys[0] == held_key:
            held.append(fps[: ends[0]])
            first = 1
            if len(starts) == 1:
                continue
        if held:
            yield np.concatenate(held)
        many = np.flatnonzero(ends - starts > 1)
        for g in many[(many >= first) & (many < len(starts) - 1)].tolist():
            yield fps[starts[g] : ends[g]]
        held_key, held = keys[-1], [fps[starts[-1] :]]
    if held:
        yield np.concatenate(held)


def links(distinct: DataFrame, k: int) -> DataFrame:
    """Edges (u, v) between fingerprints, enough to connect all that are within k bits."""
    keyed = distinct.select("fp", F.explode(variants(F.col("fp"), k)).alias("variant")).repartition("variant").sortWithinPartitions("variant")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (group_links(g, k) for g in groups(batches) if len(g) > 1)
        signed = lambda xs: np.array(xs, np.uint64).view(np.int64).tolist()
        return stars((signed(us), signed(vs)) for us, vs in found if us)

    return keyed.mapInArrow(tidy(run), "u long, v long")


def _classes(df: DataFrame, key: str, text: str, k: int, words: int, seed: int) -> DataFrame:
    """id, text_hash, fp, root (a fingerprint that names the component) and component_id of every row."""
    fps, _ = materialize(df.sparkSession, fingerprints(df, key, text, words, seed), "fingerprints")
    return classes(fps, lambda distinct: links(distinct, k))


def classes(fps: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """_classes of id, text_hash, fp; linked makes the edges from the distinct fingerprints (fp, least)."""
    spark = fps.sparkSession
    distinct, distinct_path = materialize(spark, fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(spark, linked(distinct), shrunk=True)
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # written before they are joined: both sides are then dealt anew, and a root that many share can be split
    rooted, rooted_path = materialize(spark, rooted, "rooted")
    smallest, smallest_path = materialize(spark, rooted.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    named, _ = materialize(spark, rooted.join(smallest, "root").select("fp", "root", "component_id"), "named")
    for path in (distinct_path, rooted_path, smallest_path):
        drop_table(spark, path)
    return fps.join(named, "fp")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id (smallest key reachable) of every row; other columns are left out."""
    rows = _classes(df, key, text, k, words, seed)
    return rows.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """df with one row of each component: one with the smallest key (of several texts under it, one; of repeated rows, one)."""
    return one_of_each(df, _classes(df, key, text, k, words, seed), key, text)


def one_of_each(df: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """df with one row of each component of rows (see classes)."""
    first = rows.where(F.col("id").eqNullSafe(F.col("component_id")))
    first = first.groupBy("root", "id", "text_hash").agg(F.count("*").alias("n")).groupBy("root").agg(F.min(F.struct("text_hash", "id", "n")).alias("one"))
    kept, _ = materialize(df.sparkSession, first.select(F.col("one.id").alias("_id"), F.col("one.text_hash").alias("_hash"), F.col("one.n").alias("_n")), "kept")
    rows = df.join(kept, df[key].eqNullSafe(kept["_id"]) & (F.xxhash64(df[text]) == kept["_hash"]))
    own = [df[c] for c in df.columns]
    once, more = rows.where(kept["_n"] == 1).select(*own), rows.where(kept["_n"] > 1).select(*own)
    return once.unionByName(more.dropDuplicates([key, text]))
