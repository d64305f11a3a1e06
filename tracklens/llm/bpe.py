"""Byte-level BPE encoding and decoding with tree concatenation.

A text is cut at its special tokens and before white space; ids of short
words are kept in a bounded table per Python worker. Longer words are split
by the tokenizer's pattern. A long unsplit piece is cut into leaves, which are encoded apart and joined
pairwise like a tree: around each join a window of tokens is encoded anew,
growing until its first and its last token are the ones it replaces. Then
every two neighbouring tokens are a pair that BPE leaves as it is, which
makes the joined sequence the exact encoding of the whole piece.

Texts above ``LONG`` characters do not occupy one task: they become rows of
text chunks (cut between pieces) and leaves, are encoded wherever Spark puts
them, and meet again in one small group per text to be joined.

Defined results: NULL and empty texts have no tokens; the special tokens'
strings are encoded as special tokens; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import stage

TOKENIZER = "byte_bpe_50k.json"
#: Fixed value: the byte-level splitting pattern of the vocabulary (white space as Unicode defines it).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: A word and the white space before it. The pattern never matches across the start of white space after something else.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNKS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
LEAF = 64  # bytes of a leaf of a long piece
WINDOW = 4  # tokens on either side of a join, at first
LONG = 1 << 16  # characters from which a text is spread over tasks
CHUNK = 1 << 14  # characters of a chunk of a long text
NONE = 1 << 60  # the rank of a pair that isn't merged
KNOWN = 400_000  # words whose ids a worker keeps
SLICE = 256


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable Latin-1 bytes themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """One vocabulary; ids are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        for token, i in special.items():
            self.token_bytes[i] = token.encode()
        self.special = {t: np.uint32(i).tobytes() for t, i in special.items()}
        self.byte_id = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        merges = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.pieces = regex.compile(PATTERN).findall
        if all(self.made[r] == 256 + r for r in range(len(self.made))):  # ids are ranks
            ranks = {t: i for i, t in enumerate(self.token_bytes[: 256 + len(self.made)])}
            self.short = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            self.short = lambda chunk: [i for p in self.pieces(chunk) for i in self.piece(p)]
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.known: dict[str, bytes] = {}

    # -- one piece

    def plain(self, piece: bytes) -> list[int]:
        """Merge the leftmost pair of lowest rank until there is none."""
        ids, rank = [self.byte_id[b] for b in piece], self.rank
        ranks = [rank.get(p, NONE) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) != NONE:
            i = ranks.index(best)
            ids[i : i + 2] = [self.made[best]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get((ids[i], ids[i + 1]), NONE)
            if i:
                ranks[i - 1] = rank.get((ids[i - 1], ids[i]), NONE)
        return ids

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of the bytes behind ``a`` and ``b``, both encodings themselves."""
        left = right = WINDOW
        while a and b:
            left, right = min(left, len(a)), min(right, len(b))
            tail, head = a[len(a) - left :], b[:right]
            new = self.plain(b"".join(map(self.token_bytes.__getitem__, tail + head)))
            left_ok = left == len(a) or new[0] == tail[0]
            right_ok = right == len(b) or new[-1] == head[-1]
            if left_ok and right_ok:
                return a[: len(a) - left] + new + b[right:]
            left, right = left if left_ok else left * 2, right if right_ok else right * 2
        return a + b

    def tree(self, parts: list[list[int]]) -> list[int]:
        """Neighbours are joined level by level."""
        while len(parts) > 1:
            pairs = [self.join(parts[i], parts[i + 1]) for i in range(0, len(parts) - 1, 2)]
            parts = pairs + parts[len(parts) & ~1 :]
        return parts[0] if parts else []

    def piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        return self.plain(raw) if len(raw) <= LEAF else self.tree([self.plain(x) for x in leaves(raw)])

    def chunk(self, chunk: str) -> bytes:
        """Ids of a word with the white space before it; kept if the word is short."""
        if len(chunk) > LEAF:
            return np.array([i for p in self.pieces(chunk) for i in self.piece(p)], dtype="<u4").tobytes()
        packed = np.array(self.short(chunk), dtype="<u4").tobytes()
        if len(self.known) >= KNOWN:
            self.known.clear()
        self.known[chunk] = packed
        return packed

    # -- texts

    def segments(self, text: str) -> Iterator[tuple[str, bytes | None]]:
        """Text between special tokens, and special tokens with their id."""
        for s in self.at_special.split(text) if self.at_special else [text]:
            if s:
                yield s, self.special.get(s)

    def encode(self, text: str) -> bytes:
        known, out = self.known, []
        for s, special in self.segments(text):
            if special:
                out.append(special)
                continue
            for c in CHUNKS(s):
                out.append(known.get(c) or self.chunk(c))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text behind ids; what isn't UTF-8 becomes U+FFFD."""
        raw = b"".join(map(self.token_bytes.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "replace").encode()


def leaves(raw: bytes) -> list[bytes]:
    """Halves of halves until none is above ``LEAF`` bytes."""
    n = 1
    while len(raw) > n * LEAF:
        n *= 2
    cut = [len(raw) * i // n for i in range(n + 1)]
    return [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]


@lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


# ---- tables -------------------------------------------------------------

COLUMNS = "n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"


def _digest(bpe: ByteBPE, packed: bytes) -> tuple[int, str, str, bytes]:
    decoded = bpe.decode(np.frombuffer(packed, dtype="<u4"))
    return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest(), packed


def _whole(path: str, columns: list[str]):
    """Short texts, batch by batch: the last column is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = [_digest(bpe, bpe.encode(t or "")) for t in part.column(part.num_columns - 1).to_pylist()]
                n, ids_sha, text_sha, ids = zip(*made, strict=True) if made else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(ids, pa.binary())],
                    names=columns,
                )

    return run


def _spread(path: str):
    """Long texts into rows (_rid, item, leaf, part): chunks have leaf -1, leaves of one long piece share an item."""

    def rows(bpe: ByteBPE, text: str) -> Iterator[tuple[int, bytes]]:
        chunk: list[str] = []
        size = 0
        for s, special in bpe.segments(text):
            for p in [s] if special else bpe.pieces(s):
                long = not special and len(p) > LEAF
                if chunk and (long or size + len(p) > CHUNK):
                    yield -1, "".join(chunk).encode()
                    chunk, size = [], 0
                if long:
                    yield from enumerate(leaves(p.encode()))
                else:
                    chunk.append(p)
                    size += len(p)
        if chunk:
            yield -1, "".join(chunk).encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                item, made = -1, []
                for leaf, part in rows(bpe, text):
                    item += leaf <= 0
                    made.append((rid, item, leaf, part))
                for at in range(0, len(made), 1024):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made[at : at + 1024], strict=True)], names=["_rid", "item", "leaf", "part"])

    return run


def _parts(path: str):
    """Chunks and leaves encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids = [
                bpe.encode(part.decode()) if leaf < 0 else np.array(bpe.plain(part), dtype="<u4").tobytes()
                for leaf, part in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], names=["_rid", "item", "leaf", "ids"])

    return run


def _joined(path: str):
    """All parts of one text in order; leaves of a piece joined as a tree."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bpe, out = load(path), []
        pdf = pdf.sort_values(["item", "leaf"])
        for _, group in pdf.groupby("item", sort=True):
            if group["leaf"].iloc[0] < 0:
                out.append(group["ids"].iloc[0])
            else:
                ids = bpe.tree([np.frombuffer(x, dtype="<u4").tolist() for x in group["ids"]])
                out.append(np.array(ids, dtype="<u4").tobytes())
        return pd.DataFrame([(pdf["_rid"].iloc[0], *_digest(bpe, b"".join(out)))], columns=["_rid", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    return run


def encode_texts(docs: DataFrame, keep: list[str] = ["doc_id"], path: str | None = None, long: int = LONG) -> DataFrame:  # noqa: B006
    """``keep``, ``n_tokens, ids_sha256, decoded_sha256`` and ``ids`` (packed) for every row of ``docs(text, ...)``."""
    path = path or tokenizer_path()
    rows = docs.select(*keep, "text")
    is_long = F.coalesce(F.length("text"), F.lit(0)) > long
    short = rows.filter(~is_long)
    schema = rows.drop("text").schema
    made = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), COLUMNS])
    names = [*schema.names, "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    out = short.mapInArrow(_whole(path, names), made)
    held = stage(rows.filter(is_long).withColumn("_rid", F.monotonically_increasing_id()), "bpe-long")
    parts = held.select("_rid", "text").mapInArrow(_spread(path), "_rid long, item long, leaf long, part binary")
    ids = parts.repartition("_rid", "item", "leaf").mapInArrow(_parts(path), "_rid long, item long, leaf long, ids binary")
    whole = ids.groupBy("_rid").applyInPandas(_joined(path), f"_rid long, {COLUMNS}")
    return out.union(held.drop("text").join(whole, "_rid").select(names))
