"""BPE encoding by backtracking over longest matches, decoding by an offset table.

The encoder takes the longest vocabulary match at each place (Aho-Corasick) and steps
back to a shorter one where two neighbours could not have come out of the merges. That
gives exactly the tokens of the merge procedure, in time linear in the word.

Files follow the `tokenizers` JSON format with NFC, lower-casing, white space dropped and
an end-of-word suffix. Defined cases: a null text is an empty one; empty texts give no
tokens and an empty decoded text; strings of added tokens become those tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdom.llm.common import MAX_BROADCAST_BYTES, tidy

#: The pre-tokenizer pattern of the file, fixed by its format.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Stands for the end of a word inside the automaton; no byte maps to it.
END = "\ue000"
#: Words kept in a worker's memo, and bytes of ids that are decoded at once.
MEMO, SLICE = 1 << 18, 1 << 18
#: White space to str.split() that the pattern does not count as such.
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACE = regex.compile(r"\s+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Memo:
    """Two generations: when the young one is full it becomes the old one, so frequent words stay."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def put(self, key, value):
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        self.young[key] = value
        return value


class BacktrackingBPE:
    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {a + b: (a, b) for a, b in merges}
        # order: single symbols, then merges by rank
        names = [t for t in vocab if t not in made] + [a + b for a, b in merges]
        order = {t: i for i, t in enumerate(names)}
        self.ids = np.array([vocab[t] for t in names], np.uint32)
        self.split = [(i, i) if t not in made else (order[made[t][0]], order[made[t][1]]) for i, t in enumerate(names)]
        self.pairs = {(order[a], order[b]): order[a + b] for a, b in merges}
        keys = [t[: -len(self.suffix)] + END if self.suffix and t.endswith(self.suffix) else t for t in names]
        at = {k: i for i, k in enumerate(keys)}
        self.length = [len(k) for k in keys]
        self.shorter = [next((at[k[:n]] for n in range(len(k) - 1, 0, -1) if k[:n] in at), -1) for k in keys]
        self.automaton = ahocorasick.Automaton()
        for k, i in at.items():
            self.automaton.add_word(k, i)
        self.automaton.make_automaton()
        self.alphabet = byte_alphabet()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        self.added_split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        # decoding: every token's bytes with the separator behind it, and where each begins
        strings = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        parts = [strings.get(i, "").encode() + b" " for i in range(max(strings) + 1)]
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.offsets = np.cumsum([0, *map(len, parts)])
        self.whole = {k: i for k, i in at.items() if not self.suffix or k.endswith(END)}
        self.chunks, self.pieces, self.neighbours = Memo(MEMO), Memo(MEMO), Memo(MEMO)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges could leave these two side by side."""
        limit = 1 << 60
        while True:
            joined = self.pairs.get((left, right))
            if joined is not None and joined < limit:
                return False
            if left > right:
                limit, left = left, self.split[left][1]
                if left == limit:
                    limit, right = right + 1, self.split[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, self.split[right][0]
                if right + 1 == limit:
                    limit, left = left, self.split[left][1]
                    if left == limit:
                        return True

    def word(self, piece: str) -> list[int]:
        """Orders of the tokens of one pre-token."""
        # the letters of ASCII stand for themselves
        text = (piece if piece.isascii() and piece.isalpha() else "".join([self.alphabet[b] for b in piece.encode()])) + (END if self.suffix else "")
        if (token := self.whole.get(text)) is not None:
            return [token]
        n, longest, length, shorter, known = len(text), {}, self.length, self.shorter, self.neighbours
        for end, token in self.automaton.iter(text):
            longest[end + 1 - length[token]] = token
        alive = bytearray(b"\1") * (n + 1)
        if self.suffix:
            alive[n - 1] = 0
        out: list[int] = []
        at, token, last = 0, longest.get(0), None
        while token is not None:
            end = at + length[token]
            if alive[end]:
                if last is None:
                    fits = True
                elif (fits := known.young.get(last << 32 | token)) is None:
                    fits = known.put(last << 32 | token, self.compatible(last, token))
                if fits:
                    out.append(token)
                    at, last, token = end, token, longest.get(end)
                    continue
            if shorter[token] >= 0:
                token = shorter[token]
                continue
            if last is None:
                raise ValueError(f"the vocabulary cannot spell {piece!r}")
            alive[at] = 0  # nothing that ends here leads on
            token = out.pop()
            at -= length[token]
            last = out[-1] if out else None
        if at != n:
            raise ValueError(f"the vocabulary cannot spell {piece!r}")
        return out

    def piece(self, piece: str) -> bytes:
        """Ids of one pre-token, as little-endian 32-bit integers."""
        memo = self.pieces
        got = memo.young.get(piece)
        if got is None:
            got = memo.put(piece, memo.old.get(piece) or self.ids[self.word(piece)].tobytes())
        return got

    def chunk(self, raw: str) -> bytes:
        """Ids of a stretch without white space."""
        if raw.isascii():
            if raw.isalpha():
                return self.piece(raw.lower())
            if raw[:-1].isalpha():  # a word and its punctuation mark, or a digit
                return self.piece(raw[:-1].lower()) + self.piece(raw[-1])
        out = []
        for k, part in enumerate(self.added_split.split(raw) if self.added_split else [raw]):
            if k % 2:
                out.append(np.uint32(self.added[part]).tobytes())
            elif part:
                # lower-casing by character: no final-sigma rule
                clean = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += map(self.piece, PIECES.findall(clean))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        chunks = SPACE.split(text) if SEPARATORS.search(text) else text.split()
        memo, out = self.chunks, []
        young, old = memo.young, memo.old
        for c in chunks:
            got = young.get(c)
            if got is None:
                got = old.get(c)
                if got is None:
                    got = self.chunk(c)
                if len(c) < 64:
                    memo.put(c, got)
                    young, old = memo.young, memo.old
            out.append(got)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        """The decoded text in UTF-8, in slices; tokens are set apart by spaces."""
        for k in range(0, len(ids), SLICE):
            part = ids[k : k + SLICE].astype(np.int64)
            start, size = self.offsets[part], self.offsets[part + 1] - self.offsets[part]
            ends = np.cumsum(size)
            where = np.repeat(start - (ends - size), size) + np.arange(ends[-1])
            out = self.blob[where].tobytes()
            yield out if k + SLICE < len(ids) else out[:-1]


def encode_decode(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded text) for every row; other columns are left out.

    vocabulary is a file that the driver can read; its bytes are broadcast, under a fixed bound.
    """
    with open(vocabulary, "rb") as f:
        data = f.read()
    if len(data) > MAX_BROADCAST_BYTES:
        raise ValueError(f"vocabulary file of {len(data)} bytes; at most {MAX_BROADCAST_BYTES} are broadcast")
    sent = df.sparkSession.sparkContext.broadcast(data)
    rows = df.select(F.col(key), F.col(text))
    schema = f"{key} {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["decoded"] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = BacktrackingBPE(json.loads(sent.value))  # gone with its task: kept workers hold no tables for other stages
        for b in batches:
            counts, ids_sha, text_sha, all_ids, all_text = [], [], [], [], []
            for t in b.column(1):
                packed = bpe.encode(t.as_py() or "")
                ids, sha = np.frombuffer(packed, "<u4"), hashlib.sha256()
                for part in (decoded := list(bpe.decode(ids)) if with_text else bpe.decode(ids)):
                    sha.update(part)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(sha.hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
                if with_text:
                    all_text.append(b"".join(decoded).decode())
            more = [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids + [pa.array(all_text, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha), *more], names)

    return rows.mapInArrow(tidy(run), schema)
