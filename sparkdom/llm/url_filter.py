"""URL filter: a sorted array of 64-bit digests with the full strings behind it.

Rules are (host, path, verdict). A rule fits its host and every subdomain of it when
the url's path starts with the rule's path; of several the longest wins (host and path
together, then the longer host). An url that no rule fits gets the default verdict.

Defined cases: a null url, and one without "://", has empty host and path, and so the
default verdict; an empty rule list gives every url the default; of two rules with the
same host and path the later one counts; repeated rows are judged each for itself; of a
very long url only the prefixes and parent hosts that a rule could have are probed.

The packed array is written into the shared folder and sent as a file of the
application: Spark puts one copy on each executor, whose workers map it and share its
pages, whatever the length of the list.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdom.llm.common import new_path

Rule = tuple[str, str, str]
#: Bytes of the packed file handed to the file system at once.
PIECE = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class DigestArray:
    """Sorted xxhash64 keys, each with the offset of its string: `keys | offsets | values | strings`.

    The buffer may be a read-only memory map. A value is a small number (here the
    verdict's); a string entered twice has the later value.
    """

    def __init__(self, buf: bytes | mmap.mmap):
        (n,) = struct.unpack_from("<Q", buf, 0)
        self.keys = np.frombuffer(buf, "<u8", n, 8)
        self.offsets = np.frombuffer(buf, "<u8", n + 1, 8 + 8 * n)
        self.values = np.frombuffer(buf, "<i4", n, 16 + 16 * n)
        self.buf, self.base = buf, 16 + 20 * n

    @staticmethod
    def pack(strings: list[bytes], values: Sequence[int], digest: Callable[[bytes], int] = xxhash.xxh64_intdigest) -> Iterator[bytes]:
        """The packed form, in pieces."""
        keys = np.fromiter(map(digest, strings), np.uint64, len(strings))
        order = np.argsort(keys, kind="stable")
        again = np.flatnonzero(np.diff(keys[order]) == 0)
        drop, runs = set(), np.split(again, np.flatnonzero(np.diff(again) != 1) + 1) if len(again) else []
        for run in runs:  # equal digests: of equal strings the last entered stays
            members = order[run[0] : run[-1] + 2].tolist()
            last = {strings[m]: m for m in members}
            drop.update(m for m in members if last[strings[m]] != m)
        if drop:
            order = order[~np.isin(order, list(drop))]
        sizes = np.fromiter((len(strings[k]) for k in order), np.uint64, len(order))
        yield struct.pack("<Q", len(order))
        yield keys[order].astype("<u8").tobytes()
        yield np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes()
        yield np.asarray(values, "<i4")[order].tobytes()
        for k in range(0, len(order), 1 << 16):
            yield b"".join(strings[i] for i in order[k : k + (1 << 16)].tolist())

    @classmethod
    def mapped(cls, path: str) -> DigestArray:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def string(self, i: int) -> bytes:
        return self.buf[self.base + int(self.offsets[i]) : self.base + int(self.offsets[i + 1])]

    def probe(self, strings: Sequence[bytes], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        """The place of each string, or -1. One binary search for all; equal digests are settled by the stored strings."""
        out = np.full(len(strings), -1, np.int64)
        if not len(self.keys) or not strings:
            return out
        keys = np.fromiter(map(digest, strings), np.uint64, len(strings))
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        for i in np.flatnonzero(hi > lo).tolist():
            for j in range(int(lo[i]), int(hi[i])):
                if self.string(j) == strings[i]:
                    out[i] = j
        return out


def _name(host: str, path: str) -> bytes:
    return f"{host}\n{path}".encode()


def _candidates(host: str, path: str, lengths: list[int], labels: int) -> list[tuple[str, str]]:
    """What a rule that fits could be named: hosts of up to so many labels, and beginnings of the path."""
    parts = host.rsplit(".", labels)
    hosts = [host] if len(parts) <= labels else []
    hosts += [".".join(parts[k:]) for k in range(1, len(parts))]
    return [(h, path[:n]) for h in hosts for n in lengths if n <= len(path)]


_maps: dict[str, DigestArray] = {}


def _index(name: str) -> DigestArray:
    """The file as this worker has mapped it."""
    if name not in _maps:
        _maps[name] = DigestArray.mapped(SparkFiles.get(name))
    return _maps[name]


def send(spark: SparkSession, pieces: Iterable[bytes]) -> str:
    """Write pieces as a file of the shared folder and add it to the application; its name there."""
    path = new_path(spark, "digests")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    for piece in pieces:
        for k in range(0, len(piece), PIECE):
            out.write(bytearray(piece[k : k + PIECE]))
    out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def filter_urls(df: DataFrame, rules: Iterable[Rule], key: str, url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule, verdict for every row; other columns of df are left out."""
    names: list[bytes] = []
    kinds: dict[str, int] = {}
    values, lengths, labels = [], set(), 0
    for h, p, v in rules:
        names.append(_name(h, p))
        values.append(kinds.setdefault(v, len(kinds)))
        lengths.add(len(p))
        labels = max(labels, h.count(".") + 1)
    parsed = df.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    name, verdicts, ordered = send(df.sparkSession, DigestArray.pack(names, values)), list(kinds), sorted(lengths)
    schema = T.StructType([*parsed.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name)
        for b in batches:
            probes, owner = [], []
            for i, (h, p) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                for c in _candidates(h, p, ordered, labels):
                    probes.append(_name(*c))
                    owner.append(i)
            best: dict[int, tuple[int, int, int]] = {}
            found = index.probe(probes)
            for k in np.flatnonzero(found >= 0).tolist():
                h, _, p = probes[k].decode().partition("\n")
                best[owner[k]] = max(best.get(owner[k], (-1, -1, -1)), (len(h) + len(p), len(h), int(found[k])))
            got = [(index.string(best[i][2]).decode().replace("\n", "", 1), verdicts[index.values[best[i][2]]]) if i in best else (None, default) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r for r, _ in got], pa.string()), pa.array([v for _, v in got], pa.string())], [*b.schema.names, "rule", "verdict"])

    return parsed.mapInArrow(run, schema)
