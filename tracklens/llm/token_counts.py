"""Token counts by a tokenizer compiled to a finite-state transducer.

The transducer reads a text character by character. Every transition carries
the number of tokens it adds, so that the sum over the path is the number of
tokens of what has been read; it may be negative, because a character can
turn two tokens into one. The splitting pattern and the merges are one
machine: a state holds which alternative of the pattern is being matched and
where the byte pairs stand.

Where the pairs stand: in a sequence of tokens that BPE leaves as it is, so
is every beginning of it. The last token of each prefix therefore settles the
whole encoding, and a token can follow another one exactly if BPE leaves the
two as they are. The next last token covers a suffix of what has been read,
so a state needs the last token (and how many tokens fewer there were) at
those places only whose rest is the beginning of some token. That is a finite
set. States are compiled when a text first meets them and shared by all texts
of a worker; beyond ``STATES`` of them the machine starts anew.

Texts are cut into chunks of ``CHUNK`` characters. What a chunk does to an
unknown state is a map: up to its first reset (a place before which a piece
ends, whatever came before) it is the text to be read, behind it a number of
tokens, and from its last reset on the text that its final state has read.
Maps compose; the composition is associative, so a prefix scan over a text's
chunks gives the count at every chunk's end, in any grouping. Texts above
``LONG`` characters are spread over tasks and their maps scanned level by
level in groups of ``FAN``.

Defined results: a NULL text has no bytes and no tokens; the special token's
string counts as one token wherever it stands; repeated rows give repeated
results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.llm.bpe import CHUNKS, NONE, ByteBPE, tokenizer_path
from tracklens.llm.common import stage

LIMIT = 512  # tokens of the report's context window
CHUNK = 1 << 12  # characters of a chunk
LONG = 1 << 18  # characters from which a text is spread over tasks
FAN = 64  # chunk maps of one text that one group composes
STATES = 400_000  # of a worker's machine
PAIRS = 500_000  # token pairs whose fate is kept
WORDS = 500_000  # composed transitions that are kept, of words up to ``WORD`` characters
WORD = 64
SLICE = 256

LETTER, NUMBER, OTHER, SPACE = "L", "N", "O", "S"
#: Fixed value: what may follow an apostrophe at the start of a piece, and how it goes on.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", {"r": "e", "v": "e", "l": "l"}
#: A character that starts a piece whatever stands before the two: white space after something else, or another class
#: after letters or digits (but for the bar, which stands within the special token).
RESET = r"(?<=\P{White_Space})\p{White_Space}|(?<=\p{L})[^\p{White_Space}\p{L}|]|(?<=\p{N})[^\p{White_Space}\p{N}]"
FIRST_RESET, LAST_RESET = regex.compile(RESET).search, regex.compile("(?r)" + RESET).search
CLASSES = [(c, regex.compile(p).fullmatch) for c, p in ((SPACE, r"\p{White_Space}"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}"))]


# ---- the byte-pair part -------------------------------------------------


#: A place whose rest starts some token: the rest, the last token before it (None at the start of the piece) and how
#: many tokens fewer there were.
Place = tuple[bytes, int | None, int]
START: tuple[Place, ...] = ((b"", None, 0),)


class Pairs:
    """Steps of the encoding of one piece, byte by byte."""

    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe
        special = {int.from_bytes(i, "little") for i in bpe.special.values()}
        self.token = {raw: i for i, raw in enumerate(bpe.token_bytes) if raw and i not in special}
        self.beginnings = {(b := raw[:n]): b for raw in self.token for n in range(len(raw) + 1)}
        self.merge = {made: (a, b, r) for ((a, b), r), made in zip(bpe.rank.items(), bpe.made, strict=True)}
        self.edges: tuple[dict, dict] = ({}, {})
        self.whole: dict[int, bool] = {}
        self.known: dict[tuple[int, int], bool] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge (0 left, 1 right) while ``token`` is merged, each with the rank that ends it."""
        if token not in self.edges[side]:
            made = self.merge.get(token)
            inner = [] if made is None else [*self.edge(made[side], side)[:-1], (made[side], made[2])]
            self.edges[side][token] = [*inner, (token, NONE)]
        return self.edges[side][token]

    def alone(self, token: int) -> bool:
        """BPE makes the token's bytes this token."""
        if token not in self.whole:
            self.whole[token] = self.bpe.plain(self.bpe.token_bytes[token]) == [token]
        return self.whole[token]

    def follows(self, last: int | None, token: int) -> bool:
        """BPE leaves the two tokens as they are (or the one, at the start of a piece).

        It does unless a merge across their border comes first. What stands
        at the border only grows, left of it and right of it, each growth at
        the rank of a merge, so all pairs that ever meet there are walked in
        the order of ranks. Of two merges of one rank the left one is first.
        """
        if last is None:
            return self.alone(token)
        found = self.known.get((last, token))
        if found is None:
            found = self.alone(token)
            left, right = self.edge(last, 1), self.edge(token, 0)
            i = j = 0
            while found:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                rank = self.bpe.rank.get((x, y), NONE)
                if rank < x_ends and rank <= y_ends and rank != NONE:
                    found = False
                elif x_ends <= y_ends:
                    if x_ends == NONE:
                        break
                    i += 1
                else:
                    j += 1
            if len(self.known) >= PAIRS:
                self.known.clear()
            self.known[last, token] = found
        return found

    def byte(self, places: tuple[Place, ...], byte: bytes) -> tuple[tuple[Place, ...], int]:
        """The places after one more byte, and the tokens it adds; places come with the longest rest first."""
        token_of, beginnings = self.token.get, self.beginnings
        grown = [(text + byte, last, fewer) for text, last, fewer in places]
        for text, last, fewer in grown:
            token = token_of(text)
            if token is not None and self.follows(last, token):
                break
        else:
            raise ValueError(f"no token ends with {byte!r}")
        added = 1 - fewer
        on = [(beginnings[text], last, less + added) for text, last, less in grown if text in beginnings]
        on.append((b"", token, 0))
        return tuple(on), added

    def read(self, places: tuple[Place, ...], text: str) -> tuple[tuple[Place, ...], int]:
        total = 0
        for b in text.encode():
            places, added = self.byte(places, bytes((b,)))
            total += added
        return places, total


# ---- the machine --------------------------------------------------------


class Key(NamedTuple):
    """What a state stands for: the alternative being matched, its places, and for white space how the run may still split."""

    kind: str
    places: tuple[Place, ...] = START
    last: str = ""
    undo: int = 0


#: kinds beside the classes: nothing read, an apostrophe at the start of a piece, one with r, v or l behind it, a whole contraction
FRESH, QUOTE, HALF, WHOLE = "fresh", "quote", "half", "whole"


class State(dict):
    """Transitions by character: the next state and the tokens added; compiled when first asked for."""

    __slots__ = ("machine", "key")

    def __init__(self, machine: Machine, key: Key):
        self.machine, self.key = machine, key

    def __missing__(self, char: str) -> tuple[State, int]:
        key, added = self.machine.step(self.key, char)
        self[char] = found = self.machine.state(key), added
        return found


class Machine:
    """A tokenizer compiled to a transducer that counts."""

    def __init__(self, bpe: ByteBPE):
        self.pairs = Pairs(bpe)
        self.special = list(bpe.special)
        self.split = regex.compile("|".join(map(regex.escape, self.special))).split if self.special else lambda text: [text]
        self.classes: dict[str, str] = {}
        self.words: dict[str, int] = {}
        self.states: dict[Key, State] = {}
        self.fresh = self.state(Key(FRESH))

    def state(self, key: Key) -> State:
        if key not in self.states:
            if len(self.states) >= STATES:
                self.states = {}
                self.fresh = self.state(Key(FRESH))
            self.states[key] = State(self, key)
        return self.states[key]

    def class_of(self, char: str) -> str:
        if char not in self.classes:
            self.classes[char] = next((c for c, match in CLASSES if match(char)), OTHER)
        return self.classes[char]

    def piece(self, text: str, kind: str) -> tuple[Key, int]:
        """The state after the start of a new piece."""
        places, added = self.pairs.read(START, text)
        return Key(kind, places), added

    def space(self, char: str) -> tuple[Key, int]:
        """A run of white space begins; all its tokens go if it turns out to be the last of the run before a piece."""
        places, added = self.pairs.read(START, char)
        return Key(SPACE, places, char, -added), added

    def step(self, key: Key, char: str) -> tuple[Key, int]:
        kind, to = key.kind, self.class_of(char)
        if to == SPACE:
            if kind != SPACE:
                return self.space(char)
            places, added = self.pairs.read(key.places, char)
            return Key(SPACE, places, char, -added), added
        if kind == SPACE:  # the run ends a character earlier; a blank opens the next piece, anything else is a piece
            if key.last == " ":
                new, added = self.piece(" " + char, to)
                return new, key.undo + added
            alone = self.pairs.read(START, key.last)[1]
            new, added = self.step(Key(FRESH), char)
            return new, key.undo + alone + added
        if kind == QUOTE and char in SHORT_ENDINGS:
            places, added = self.pairs.read(key.places, char)
            return Key(WHOLE), added
        if kind == QUOTE and char in LONG_ENDINGS:
            new, added = self.piece(char, LETTER)
            return Key(HALF, new.places, char), added
        if kind == HALF and char == LONG_ENDINGS[key.last]:
            whole = self.pairs.read(START, "'" + key.last + char)[1]
            halves = self.pairs.read(START, "'")[1] + self.pairs.read(START, key.last)[1]
            return Key(WHOLE), whole - halves
        now = {QUOTE: OTHER, HALF: LETTER}.get(kind, kind)
        if now == to:
            places, added = self.pairs.read(key.places, char)
            return Key(to, places), added
        return self.piece(char, QUOTE if char == "'" else to)

    def path(self, text: str) -> int:
        """The sum over the transitions of a text, from the state that has read nothing."""
        state, n = self.fresh, 0
        for char in text:
            state, added = state[char]
            n += added
        return n

    def count(self, text: str) -> int:
        """Tokens of a text that starts and ends where pieces do.

        White space behind something else is a reset, so the path of a word
        and the white space before it is one composed transition from and to
        the fresh state; short ones are kept.
        """
        words, n = self.words, 0
        parts = self.split(text)
        for part in parts:
            for word in CHUNKS(part):
                added = words.get(word)
                if added is None:
                    added = self.path(word)
                    if len(word) <= WORD:
                        if len(words) >= WORDS:
                            words.clear()
                        words[word] = added
                n += added
        return n + len(parts) - 1


# ---- chunk maps ---------------------------------------------------------


class Map(NamedTuple):
    """What a chunk does: read ``head``; if there is a reset (``n`` is not None) then ``n`` tokens and ``tail`` read anew."""

    head: str
    n: int | None
    tail: str


def chunk_map(machine: Machine, text: str) -> Map:
    first = FIRST_RESET(text)
    if not first:
        return Map(text, None, "")
    a, b = first.start(), LAST_RESET(text).start()
    return Map(text[:a], machine.count(text[a:b]), text[b:])


def compose(machine: Machine, a: Map, b: Map) -> Map:
    """``b`` after ``a``."""
    if a.n is None:
        return Map(a.head + b.head, b.n, b.tail)
    if b.n is None:
        return Map(a.head, a.n, a.tail + b.head)
    return Map(a.head, a.n + machine.count(a.tail + b.head) + b.n, b.tail)


def scan(machine: Machine, maps: list[Map]) -> list[Map]:
    """All prefix compositions: pairs are composed, their scan is taken, and the places between are filled in."""
    if len(maps) < 2:
        return maps
    pairs = [compose(machine, maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)]
    above = scan(machine, pairs)
    out = [maps[0]]
    for i in range(1, len(maps)):
        out.append(above[i // 2] if i % 2 else compose(machine, above[i // 2 - 1], maps[i]))
    return out


def total(machine: Machine, whole: Map) -> int:
    """The tokens of a text with this map."""
    return machine.count(whole.head) + (0 if whole.n is None else whole.n + machine.count(whole.tail))


def chunks(text: str, size: int = CHUNK) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def text_tokens(machine: Machine, text: str, size: int = CHUNK) -> int:
    maps = scan(machine, [chunk_map(machine, c) for c in chunks(text, size)])
    return total(machine, maps[-1]) if maps else 0


@lru_cache(maxsize=2)
def load(path: str) -> Machine:
    return Machine(ByteBPE(path))


# ---- tables -------------------------------------------------------------


def _whole(path: str, names: list[str]):
    """Texts that one task counts: the last column is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                n = [text_tokens(machine, t or "") for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n, pa.int64())], names=names)

    return run


MAP_COLUMNS = "_rid long, at long, head string, n long, tail string"


def _mapped(path: str):
    """Parts of long texts (_rid, at, text) to their maps, each the scan of its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = load(path)
        for batch in batches:
            for rid, at, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                whole = scan(machine, [chunk_map(machine, c) for c in chunks(text)])[-1]
                yield pa.RecordBatch.from_pylist([{"_rid": rid, "at": at, **whole._asdict()}], schema=schema)

    schema = pa.schema([("_rid", pa.int64()), ("at", pa.int64()), ("head", pa.string()), ("n", pa.int64()), ("tail", pa.string())])
    return run


def _composed(path: str):
    """A group of neighbouring maps of one text to their composition, which stands at the group's number."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        machine = load(path)
        pdf = pdf.sort_values("at")
        maps = [Map(h, None if pd.isna(n) else int(n), t) for h, n, t in zip(pdf["head"], pdf["n"], pdf["tail"], strict=True)]
        whole = scan(machine, maps)[-1]
        return pd.DataFrame({"_rid": [key[0]], "at": [key[1]], "head": [whole.head], "n": pd.array([whole.n], dtype="Int64"), "tail": [whole.tail]})

    return run


def _totals(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = load(path)
        for batch in batches:
            n = [total(machine, Map(*m)) for m in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["_rid", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, keep: list[str] = ["doc_id"], path: str | None = None, long: int = LONG) -> DataFrame:  # noqa: B006
    """``keep``, ``n_bytes`` and ``n_tokens`` of every row of ``docs(text, ...)``."""
    path = path or tokenizer_path()
    rows = docs.select(*keep, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    is_long = F.coalesce(F.length("text"), F.lit(0)) > long
    short = rows.filter(~is_long)
    out = rows.drop("text").withColumn("n_tokens", F.lit(0).cast("long"))
    counted = short.mapInArrow(_whole(path, out.columns), out.schema)
    held = stage(rows.filter(is_long).withColumn("_rid", F.monotonically_increasing_id()), "count-long")
    most = held.agg(F.max(F.length("text"))).first()[0]
    if most is None:
        return counted
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / long).cast("int"))
    parts = held.select("_rid", "text", F.explode(starts).alias("at")).select(
        "_rid", F.col("at").cast("long").alias("at"), F.substring(F.col("text"), F.col("at") * long + 1, F.lit(long)).alias("text")
    )
    maps = parts.repartition("_rid", "at").mapInArrow(_mapped(path), MAP_COLUMNS)
    groups = -(-most // long)
    while groups > 1:
        maps = maps.groupBy("_rid", F.expr(f"at div {FAN}").alias("group")).applyInPandas(_composed(path), MAP_COLUMNS)
        groups = -(-groups // FAN)
    whole = maps.select("_rid", "head", "n", "tail").mapInArrow(_totals(path), "_rid long, n_tokens long")
    return counted.union(held.drop("text").join(whole, "_rid").select(out.columns))


def over_limit(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document."""
    return count_tokens(docs).withColumn("over_limit", F.col("n_tokens") > limit)
