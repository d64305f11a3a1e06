"""Target-distribution importance resampling over hashed n-grams.

Documents are drawn so that their n-grams look like those of a target corpus.
Features (runs of one to ``ORDERS`` words) fall into ``BUCKETS`` by checksum;
a bucket's gain is the logarithm of its share in the target over its share in
the documents, a document's weight is the sum of gains over its features, and
Gumbel noise of the doc_id turns the highest weights into a draw without
replacement.

Both passes over the texts intern a batch's n-grams in an open-addressed NumPy
table. A batch's words, lower-cased and joined by single blanks, lie in one
byte buffer, so every n-gram is a slice of it. Its xxhash64 (computed for all
slices at once) is the key and leads to its first slot; a slot that is taken
by another key, or by other bytes of the same key, passes the n-gram on to the
next one. A slot stores the bucket of its n-gram and how often that occurs:
checksums are taken once per different n-gram, counting adds up slots, and a
document's weight is gathered through the slot numbers of its occurrences.

Only the ``BUCKETS`` totals meet anywhere, per task a row for each bucket that
occurs, and 8 bytes of gain per bucket go back to the tasks. Ranks come from a
range partition and the row counts of its parts.

Defined results: a NULL or wordless text has no features and weight 0; gains
are taken in the order of a document's text and sums are whole numbers, so
reruns agree; a NULL doc_id has the noise of the empty text and comes last
among equal scores; repeated rows are documents of their own; without target
texts all target counts are 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import in_order, stage

ORDERS = 3
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = 42
PIECE = 1 << 19  # bytes of text whose n-grams are interned together
MIX = np.uint64(0x9E3779B97F4A7C15)

# ---- words as slices of one buffer --------------------------------------

#: digits, small letters and everything outside ASCII belong to words; A-Z become small letters
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[0x30:0x3A] = IN_WORD[0x61:0x7B] = IN_WORD[0x80:] = True


class Words:
    """The words of some texts in one buffer, each followed by a blank: ``at``, ``size`` and ``doc`` per word."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, docs: np.ndarray):
        """``data`` holds texts that begin at ``starts`` and belong to the rows ``docs``."""
        low = LOWER[data]
        inside = IN_WORD[low]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        cut = starts[(starts > 0) & (starts < len(data))]  # texts lie side by side: a word ends with its text
        opens[cut] = inside[cut]
        closes[cut - 1] = inside[cut - 1]
        first, last = np.flatnonzero(opens), np.flatnonzero(closes)
        self.size = last - first + 1
        self.at = np.concatenate(([0], np.cumsum(self.size + 1)))[:-1]
        total = int(self.at[-1] + self.size[-1] + 1) if len(first) else 0
        # eight more blanks, so that every slice can be read in steps of eight bytes
        self.buffer = np.full(total + 40, 0x20, dtype=np.uint8)
        shift = np.repeat(self.at - first, self.size)
        source = np.flatnonzero(inside)
        self.buffer[source + shift] = low[source]
        self.doc = docs[np.searchsorted(starts, first, side="right") - 1]

    def grams(self, orders: int, fresh: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``at, size, doc`` of all runs of 1 to ``orders`` words of one text; only those with a last word in ``fresh``, if given."""
        out = []
        for k in range(1, orders + 1):
            n = len(self.at) - k + 1
            if n <= 0:
                break
            same = self.doc[:n] == self.doc[k - 1 :]
            if fresh is not None:
                same &= fresh[k - 1 :]
            i = np.flatnonzero(same)
            out.append((self.at[i], self.at[i + k - 1] + self.size[i + k - 1] - self.at[i], self.doc[i]))
        if not out:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# ---- xxhash64 of many slices --------------------------------------------

#: The primes of xxhash64.
P1, P2, P3, P4, P5 = map(
    np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(acc: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _turn(acc + word * P2, 31) * P1


def by_size(size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each size and the rows that have it."""
    if not len(size):
        return
    narrow = size.max() < 1 << 16  # NumPy sorts short integers by radix
    order = np.argsort(size.astype(np.uint16) if narrow else size, kind="stable")
    sizes, first = np.unique(size[order], return_index=True)
    yield from zip(sizes.tolist(), np.split(order, first[1:]), strict=True)


def slice_hashes(buffer: np.ndarray, at: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """xxhash64 of every slice; slices of one length go through the same steps together."""
    eight = np.ndarray(len(buffer) - 7, dtype="<u8", buffer=buffer, strides=(1,))
    four = np.ndarray(len(buffer) - 3, dtype="<u4", buffer=buffer, strides=(1,))
    out = np.empty(len(at), dtype=np.uint64)
    for n, rows in by_size(size):
        p, done = at[rows], 0
        if n >= 32:
            lanes = [np.full(len(p), s, dtype=np.uint64) for s in ((seed + int(P1) + int(P2)) % 2**64, (seed + int(P2)) % 2**64, seed, (seed - int(P1)) % 2**64)]
            while done + 32 <= n:
                lanes = [_round(lane, eight[p + (done + 8 * i)]) for i, lane in enumerate(lanes)]
                done += 32
            acc = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
            for lane in lanes:
                acc = (acc ^ _round(np.uint64(0), lane)) * P1 + P4
            acc += np.uint64(n)
        else:
            acc = np.full(len(p), (seed + int(P5) + n) % 2**64, dtype=np.uint64)
        while done + 8 <= n:
            acc = _turn(acc ^ _round(np.uint64(0), eight[p + done]), 27) * P1 + P4
            done += 8
        if done + 4 <= n:
            acc = _turn(acc ^ (four[p + done].astype(np.uint64) * P1), 23) * P2 + P3
            done += 4
        while done < n:
            acc = _turn(acc ^ (buffer[p + done].astype(np.uint64) * P5), 11) * P1
            done += 1
        acc = (acc ^ (acc >> np.uint64(33))) * P2
        acc = (acc ^ (acc >> np.uint64(29))) * P3
        out[rows] = acc ^ (acc >> np.uint64(32))
    return out


# ---- checksums of many slices -------------------------------------------

#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def crc_tables() -> np.ndarray:
    """What a byte does to the checksum when 0 to 3 more bytes follow."""
    out = np.zeros((4, 256), dtype=np.uint32)
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = (row >> 1) ^ np.where(row & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    out[0] = row
    for k in range(1, 4):
        out[k] = row[out[k - 1] & 255] ^ (out[k - 1] >> 8)
    return out


CRC = crc_tables()


def slice_checksums(buffer: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of every slice, four bytes a step."""
    four = np.ndarray(len(buffer) - 3, dtype="<u4", buffer=buffer, strides=(1,))
    out = np.empty(len(at), dtype=np.uint32)
    for n, rows in by_size(size):
        p, done = at[rows], 0
        crc = np.full(len(p), 0xFFFFFFFF, dtype=np.uint32)
        while done + 4 <= n:
            crc ^= four[p + done]
            crc = CRC[3][crc & 255] ^ CRC[2][crc >> 8 & 255] ^ CRC[1][crc >> 16 & 255] ^ CRC[0][crc >> 24]
            done += 4
        while done < n:
            crc = CRC[0][(crc ^ buffer[p + done]) & 255] ^ (crc >> 8)
            done += 1
        out[rows] = ~crc
    return out


# ---- the table ----------------------------------------------------------


def same_bytes(buffer: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether slices of equal ``size`` at ``a`` and ``b`` hold the same bytes."""
    eight = np.ndarray(len(buffer) - 7, dtype="<u8", buffer=buffer, strides=(1,))
    same = np.ones(len(a), dtype=bool)
    rows = np.flatnonzero(a != b)
    done = 0
    while len(rows):
        left = size[rows] - done
        unused = np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64))
        differ = ((eight[a[rows] + done] ^ eight[b[rows] + done]) << unused) != 0
        same[rows[differ]] = False
        done += 8
        rows = rows[~differ & (left > 8)]
    return same


class Interned:
    """An open-addressed table of n-grams: ``slot`` per occurrence, ``bucket`` and ``count`` per slot."""

    def __init__(self, buffer: np.ndarray, at: np.ndarray, size: np.ndarray, buckets: int = BUCKETS, keys: np.ndarray | None = None):
        keys = slice_hashes(buffer, at, size) if keys is None else keys
        bits = max(4, int(2 * len(at)).bit_length())
        room = 1 << bits
        owner = np.full(room, -1, dtype=np.int64)  # the occurrence that took the slot
        self.slot = np.zeros(len(at), dtype=np.int64)
        rows, place = np.arange(len(at)), ((keys * MIX) >> np.uint64(64 - bits)).astype(np.int64)
        while len(rows):
            free = owner[place] < 0
            owner[place[free]] = rows[free]  # of several, one stays
            held = owner[place]
            here = (keys[held] == keys[rows]) & (size[held] == size[rows])
            sure = np.flatnonzero(here)
            here[sure] = same_bytes(buffer, at[held[sure]], at[rows[sure]], size[rows[sure]])
            self.slot[rows[here]] = place[here]
            rows, place = rows[~here], (place[~here] + 1) & (room - 1)
        self.count = np.bincount(self.slot, minlength=room)
        self.bucket = np.zeros(room, dtype=np.int64)
        taken = np.flatnonzero(owner >= 0)
        self.bucket[taken] = slice_checksums(buffer, at[owner[taken]], size[owner[taken]]) % np.uint32(buckets)


def pieces(column: pa.Array, limit: int = PIECE, orders: int = ORDERS) -> Iterator[tuple[Words, np.ndarray | None]]:
    """The texts of a batch in pieces of about ``limit`` bytes, with the words that count in each.

    A text above the limit is cut behind a word; the next piece starts with
    the ``orders - 1`` words before the cut, which count no more by themselves.
    """
    column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    doc = 0
    while doc < len(column):
        last = int(np.searchsorted(bounds, bounds[doc] + limit, side="right")) - 1
        if last > doc:
            a, b = bounds[doc], bounds[last]
            yield Words(data[a:b], bounds[doc:last] - a, np.arange(doc, last)), None
            doc = last
            continue
        at, end, before = int(bounds[doc]), int(bounds[doc + 1]), 0
        while at < end:
            stop = min(at + limit, end)
            if stop < end:  # cut where a word has ended; a word longer than the limit stays whole
                outside = ~IN_WORD[LOWER[data[at:stop]]]
                if outside.any():
                    stop = at + int(np.flatnonzero(outside)[-1]) + 1
                else:
                    while stop < end and IN_WORD[LOWER[data[stop]]]:
                        stop += 1
            start, skip = at, 0
            while start > bounds[doc] and skip < before:  # back over the words that still begin n-grams
                start -= 1
                while start > bounds[doc] and not IN_WORD[LOWER[data[start]]]:
                    start -= 1
                while start > bounds[doc] and IN_WORD[LOWER[data[start - 1]]]:
                    start -= 1
                skip += 1
            words = Words(data[start:stop], np.array([0]), np.array([doc]))
            fresh = np.arange(len(words.at)) >= skip
            yield words, fresh
            before = min(orders - 1, before + int(fresh.sum()))
            at = stop
        doc += 1


# ---- passes -------------------------------------------------------------


def bucket_counts(docs: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: occurrences of features over all texts of ``docs(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for words, fresh in pieces(batch.column(0), orders=orders):
                at, size, _ = words.grams(orders, fresh)
                table = Interned(words.buffer, at, size, buckets)
                total += np.bincount(table.bucket, weights=table.count, minlength=buckets).astype(np.int64)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], names=["bucket", "n"])

    parts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """Gain per bucket, a table of fixed size: floor of 1000 times the logarithm of the smoothed shares' quotient."""
    own, aim = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
    for counts, source in ((own, docs), (aim, target)):
        for bucket, n in bucket_counts(source, orders, buckets).collect():  # at most ``buckets`` rows
            counts[bucket] = n
    s_all, t_all = float(own.sum()) + buckets, float(aim.sum()) + buckets
    share = [(t + 1.0) * s_all / ((s + 1.0) * t_all) for s, t in zip(own.tolist(), aim.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in share], dtype=np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, orders: int = ORDERS) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row of ``docs(doc_id, text)``."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    longs = {c: F.lit(0).cast("long") for c in ("n_words", "n_features", "weight")}
    schema = rows.drop("text").withColumns(longs).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((3, batch.num_rows), dtype=np.int64)
            for words, fresh in pieces(batch.column(1), orders=orders):
                at, size, doc = words.grams(orders, fresh)
                table = Interned(words.buffer, at, size, len(gains))
                gain = gains[table.bucket][table.slot]
                np.add.at(found[0], words.doc if fresh is None else words.doc[fresh], 1)
                np.add.at(found[1], doc, 1)
                np.add.at(found[2], doc, gain)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found)], names=schema.names)

    return rows.mapInArrow(run, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the digest of the seed and the doc_id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row; ``rank`` counts the drawn ones by falling score."""
    weighed = weigh(docs, bucket_gains(docs, target))
    scored = stage(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"))), "resample-scored")
    may = F.col("n_words") >= min_words
    keys = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    ordered = in_order(scored.filter(may).select("doc_id", "n_features", "weight", "score"), keys, "resample-order")
    # one row per range partition: how many rows lie in those before it
    sizes = sorted((r["_pid"], r["count"]) for r in ordered.groupBy("_pid").count().collect())
    draw = percent * sum(n for _, n in sizes) // 100
    before, offsets = 0, []
    for pid, n in sizes:
        offsets.append((pid, before))
        before += n
    starts = docs.sparkSession.createDataFrame(offsets, "_pid long, _before long")
    rank = F.col("_before") + F.col("_idx") + 1
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = ordered.join(starts, "_pid").select(*columns, F.when(rank <= draw, rank).alias("rank"))
    return ranked.union(scored.filter(~may).select(*columns, F.lit(None).cast("long").alias("rank")))
