"""Near-copies by the Jaccard similarity of word shingles, checked exactly.

Candidates are found by SimHash of the shingles, through deletion variants as in simhash:
texts whose fingerprints differ in at most BITS bits. At similarity 0.8 most fingerprints
lie further apart, so MinHash finds the rest: texts that share one of BANDS keys of ROWS
minima each. Candidates of both are joined into clusters, and within a cluster every text
is compared with all that it is not linked to yet, by exact counts of common shingles.
Only texts that no chain of candidates connects are never compared: a pair at similarity
0.8 shares no key with a chance of (1 - 0.8^ROWS)^BANDS, about 5 in 10 million, and less
above.

A cluster of over CHUNK shingles is dealt into chunks by a hash, and no task holds more
than one: (1) each chunk is walked; (2) one text of each part that this gives is walked
again with those of the other chunks, dealt anew where they are many; (3) the texts that
are still outside their cluster's largest part visit all its chunks. Two texts of one
chunk meet in 1; of others, both lie in the largest part, or one visits the other: no pair
is left out. What is copied are the visitors, a row for each chunk.

Defined cases: texts of equal shingle sets are linked, null and wordless ones with one
another; a text of fewer words than a shingle is one shingle; ids as in simhash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdom.llm import simhash
from sparkdom.llm.common import drop_table, materialize, tidy
from sparkdom.llm.components import components, stars

#: Bits that SimHashes of candidates differ in; keys of a text, minima of a key, shingles hashed at once.
BITS = 4
BANDS, ROWS, SLICE = 48, 6, 1024
#: Shingles of a chunk, more or less.
CHUNK = 1 << 22


def shingles(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """Hashes of the distinct word shingles, sorted."""
    w = (text or "").encode().lower().split()
    if len(w) < words:
        w, words = ([b" ".join(w)] if w else []), 1
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(s), seed) for s in zip(*(w[i:] for i in range(words)), strict=False)], np.uint64))


def _mixers() -> tuple[np.ndarray, np.ndarray]:
    flips, odd = np.random.default_rng(3).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
    return flips, odd | np.uint64(1)


def keys(found: np.ndarray, mixers: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """A number for each band; no keys for no shingles."""
    if not len(found):
        return []
    flips, odd = mixers
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), SLICE):
        np.minimum(least, ((found[k : k + SLICE, None] ^ flips) * odd).min(0), out=least)
    return [xxhash.xxh64_intdigest(b.tobytes(), i) - (1 << 63) for i, b in enumerate(least.reshape(BANDS, ROWS))]


def walk(sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Links (positions) that connect all pairs of at least that similarity; the sets are distinct.

    Shingles of over a 64th of the sets are bits, counted 64 at a time; the others have lists of their holders.
    """
    sizes = np.array([len(s) for s in sets])
    seen, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    left, us, vs = np.ones(len(sets), bool), [], []

    def index() -> tuple[np.ndarray, ...]:
        alive, place, keep = np.flatnonzero(left), np.cumsum(left) - 1, left[owner]
        f, h = flat[keep], place[owner[keep]]
        n = np.bincount(f, minlength=len(seen))
        often = np.flatnonzero(n * 64 > len(alive)) if len(alive) > 64 else np.array([], np.int64)
        rank = np.full(len(seen), -1)
        rank[often[np.argsort(-n[often], kind="stable")]] = np.arange(len(often))
        bits, r = np.zeros((len(often) // 64 + 1, len(alive)), np.uint64), rank[f]
        dense = r >= 0
        np.bitwise_or.at(bits, (r[dense] >> 6, h[dense]), np.uint64(1) << (r[dense] & 63).astype(np.uint64))
        order = np.argsort(f[~dense], kind="stable")
        return alive, rank, bits, f[~dense][order], h[~dense][order]

    alive, rank, bits, shingle, holder = index()
    many = len(alive)
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root] = False
        many -= 1
        frontier = [root]
        while frontier and many:
            if many < len(alive) // 2:
                alive, rank, bits, shingle, holder = index()
            at = frontier.pop()
            mine = flat[starts[at] : starts[at + 1]]
            r = rank[mine]
            rare, r = mine[r < 0], r[r >= 0]
            a, b = np.searchsorted(shingle, rare), np.searchsorted(shingle, rare, "right")
            n = b - a
            where = np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)
            common = np.bincount(holder[where], minlength=len(alive))
            for w in np.unique(r >> 6):
                mask = np.bitwise_or.reduce(np.uint64(1) << (r[r >> 6 == w] & 63).astype(np.uint64))
                common += np.bitwise_count(bits[w] & mask)
            near = alive[left[alive] & (common >= least * (sizes[alive] + len(mine) - common) - 1e-9)]
            left[near] = False
            many -= len(near)
            frontier += near.tolist()
            us += near.tolist()
            vs += [root] * len(near)
    return us, vs


class Holders:
    """Sets by their shingles."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.shingles, self.owner = flat[order], owner[order]

    def near(self, found: np.ndarray, least: float) -> np.ndarray:
        """Places of the sets of at least that similarity."""
        a, b = np.searchsorted(self.shingles, found), np.searchsorted(self.shingles, found, "right")
        n = b - a
        where = np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)
        common = np.bincount(self.owner[where], minlength=len(self.sizes))
        return np.flatnonzero(common >= least * (self.sizes + len(found) - common) - 1e-9)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Second and third column of rows that are next to each other with the same first."""
    held_key, seconds, thirds = None, [], []
    for b in batches:
        for k, s, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if k != held_key and seconds:
                yield seconds, thirds
                seconds, thirds = [], []
            held_key = k
            seconds.append(s)
            thirds.append(t)
    if seconds:
        yield seconds, thirds


def _alike(prints: DataFrame) -> tuple[DataFrame, list[str]]:
    """Edges (u, v) that connect the fingerprints of sets whose SimHashes differ in at most BITS bits, and the tables they read; the empty set has none."""
    spark = prints.sparkSession
    sets, sets_path = materialize(spark, prints.where("n > 0").select("fp", "bits").distinct(), "simhashes")
    # written before it is joined, as in simhash.classes
    first, first_path = materialize(spark, sets.groupBy("bits").agg(F.min("fp").alias("first")), "simhash-firsts")
    same = sets.join(first, "bits").where("fp <> first").select(F.col("fp").alias("u"), F.col("first").alias("v"))
    at_u, at_v = first.select(F.col("bits").alias("u"), F.col("first").alias("fu")), first.select(F.col("bits").alias("v"), F.col("first").alias("fv"))
    near = simhash.links(first.select(F.col("bits").alias("fp")), BITS)
    return same.union(near.join(at_u, "u").join(at_v, "v").select("fu", "fv")), [sets_path, first_path]


def links(df: DataFrame, text: str, prints: DataFrame, least: float, words: int, seed: int) -> DataFrame:
    """Edges (u, v) between fingerprints, enough to connect all of at least that similarity."""
    spark = df.sparkSession
    keyed = prints.select("fp", F.explode("keys").alias("key")).repartition("key").sortWithinPartitions("key")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (np.unique(g) for g in simhash.groups(batches) if len(g) > 1)
        signed = (g.view(np.int64).tolist() for g in found if len(g) > 1)
        return stars((g[1:], [g[0]] * (len(g) - 1)) for g in signed)

    alike, paths = _alike(prints)
    clusters = components(spark, alike.union(keyed.mapInArrow(tidy(candidates), "u long, v long")), shrunk=True)
    for path in paths:
        drop_table(spark, path)
    one = prints.groupBy("fp").agg(F.min("text_hash").alias("text_hash"), F.min("n").alias("n"))
    members = clusters.join(one, clusters["node"] == one["fp"]).select("root", "fp", "text_hash", "n")
    texts = df.select(F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).join(members, "text_hash").select("root", "fp", "n", "text").dropDuplicates(["fp"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([shingles(t.as_py(), words, seed).tobytes() for t in b.column(3)], pa.binary())], ["root", "fp", "n", "found"])

    large, _ = materialize(spark, members.groupBy("root").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks")).where("chunks > 1"), "large")
    held = texts.mapInArrow(sets, "root long, fp long, n long, found binary")
    if large.isEmpty():
        return _walked(held.withColumn("group", F.col("root")), least)
    held, _ = materialize(spark, held, "sets")
    return _linked(held, least)


def _walked(held: DataFrame, least: float) -> DataFrame:
    """Edges that connect what is similar in each group, within one task a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked() -> Iterator[tuple[list[int], list[int]]]:
            for fps, found in _together(batches):
                us, vs = walk([np.frombuffer(f, np.uint64) for f in found], least)
                yield [fps[u] for u in us], [fps[v] for v in vs]

        return stars(linked())

    return held.select("group", "fp", "found").repartition("group").sortWithinPartitions("group", "fp").mapInArrow(tidy(run), "u long, v long")


def _visited(hosts: DataFrame, visitors: DataFrame, least: float) -> DataFrame:
    """Edges between the visitors of each group and its hosts, which alone are held."""
    both = hosts.select("group", F.lit(False).alias("visits"), "fp", "found").union(visitors.select("group", F.lit(True), "fp", "found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked() -> Iterator[tuple[list[int], list[int]]]:
            group, fps, found, holders = None, [], [], None
            for b in batches:
                for g, visits, fp, raw in zip(*b.columns, strict=True):
                    if g.as_py() != group:
                        group, fps, found, holders = g.as_py(), [], [], None
                    one = np.frombuffer(raw.as_py(), np.uint64)
                    if not visits.as_py():
                        fps.append(fp.as_py())
                        found.append(one)
                    elif fps:
                        holders = holders or Holders(found)
                        near = holders.near(one, least).tolist()
                        yield [fps[k] for k in near], [fp.as_py()] * len(near)

        return stars(linked())

    return both.repartition("group").sortWithinPartitions("group", "visits", "fp").mapInArrow(tidy(run), "u long, v long")


def _linked(held: DataFrame, least: float) -> DataFrame:
    """Edges that connect what is similar in each cluster (root, fp, n, found), clusters of many chunks included."""
    spark = held.sparkSession
    sizes, _ = materialize(spark, held.groupBy("root").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks"), F.count("*").alias("texts")), "sizes")
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    group = lambda chunk: F.when(F.col("chunks") == 1, F.col("root")).otherwise(F.xxhash64("root", chunk))
    dealt = held.join(sizes, "root").withColumn("chunk", chunk).withColumn("group", group(chunk))
    edges, _ = materialize(spark, _walked(dealt, least), "walked")
    large = sizes.where("chunks > 1")
    if large.isEmpty():
        return edges
    many = dealt.where("chunks > 1")

    def parts(edges: DataFrame) -> DataFrame:
        found = components(spark, edges)
        return many.join(found, many["fp"] == found["node"], "left").withColumn("part", F.coalesce(found["root"], many["fp"])).select(many["root"], "fp", "n", "found", "chunks", "chunk", "group", "part")

    firsts, path = materialize(spark, parts(edges).where("fp = part").select("root", "fp", "n", "found"), "firsts")
    if 2 * firsts.count() <= large.agg(F.sum("texts")).first()[0]:  # else little was joined up: all may visit
        edges, _ = materialize(spark, edges.union(_linked(firsts, least)), "joined")
    drop_table(spark, path)
    now, _ = materialize(spark, parts(edges).drop("found"), "parts")
    largest = now.groupBy("root", "part").agg(F.count("*").alias("texts")).groupBy("root").agg(F.max_by("part", F.struct("texts", "part")).alias("largest"))
    outside = now.join(largest, "root").where("part <> largest").select("fp")
    visitors = many.join(outside, "fp", "left_semi").select("root", "fp", "found", "chunks", F.col("chunk").alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    visitors = visitors.where("chunk <> own").withColumn("group", group(F.col("chunk")))
    return edges.union(_visited(many, visitors, least))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, words: int = 5, seed: int = 42) -> DataFrame:
    """df with one row of each component, as simhash.keep_one chooses it."""
    rows = df.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixers = _mixers()
        for b in batches:
            found = [shingles(t.as_py(), words, seed) for t in b.column(2)]
            fps = [xxhash.xxh64_intdigest(f.tobytes(), seed) - (1 << 63) for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array([simhash.of_hashes(f) for f in found], pa.int64()), pa.array([keys(f, mixers) for f in found], pa.list_(pa.int64()))], ["id", "text_hash", "fp", "n", "bits", "keys"])

    prints, _ = materialize(df.sparkSession, rows.mapInArrow(tidy(run), f"id {rows.schema[0].dataType.simpleString()}, text_hash long, fp long, n long, bits long, keys array<long>"), "shingle-keys")
    classes = simhash.classes(prints.drop("keys", "n", "bits"), lambda _: links(df, text, prints, least, words, seed))
    return simhash.one_of_each(df, classes, key, text)
