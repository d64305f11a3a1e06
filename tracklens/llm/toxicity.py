"""Toxicity by the nearest labelled examples in exact TF-IDF cosine.

Terms are all words of the examples, a sample of at most ``PER_CLASS``
training rows per label; none is left out. A term weighs (1 + log count)
times its inverse document frequency over all documents, times how far its
shares of toxic and clean examples lie apart (absolute log ratio, smoothed by
``SMOOTH`` rows): words alike in both classes, most words of a text, would
otherwise decide which texts are near. A word that no example holds tells
nothing and weighs 0.

The examples are held in a block-max index: they lie in blocks, and the
postings of each term keep the highest weight per block. Terms that many
examples hold are a matrix, and their part of all cosines is one product per
batch; the others add to a bound per block by their postings. Blocks are
visited by falling bound until no block can reach the k-th best cosine, which
makes the result exact. The k nearest vote with weight
``(cosine / highest cosine) ** SHARPNESS``; votes are weighted so that the
two labels count as in the labelled rows.

What depends on labels is bounded by ``PER_CLASS`` texts per label, and only
that is gathered on the driver and broadcast; all else runs over whole tables.

Defined results: rows whose doc_id has crc32 mod 5 = 0 never teach; a doc_id
with several labels counts as toxic if one of them is; labels without text
or with NULLs teach nothing; a text without any word that weighs (empty and
NULL ones too) gets the share of toxic rows among such examples; without any
labelled rows of both classes all scores are the share of toxic rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import stage

PER_CLASS = 1500  # labelled rows per label that are used, at most
SMOOTH = 8.0  # rows of the overall mix that every term is thought to be in besides
NEAREST = 16
SHARPNESS = 4
PRIOR = 0.5  # weight of the overall share of toxic rows
BLOCK = 64
COMMON = 32  # terms that one example in COMMON holds go into the matrix
FOLDS = 5
WORD = re.compile(r"\w+")
SLICE = 256


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))


# ---- learning -----------------------------------------------------------


def examples(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """``doc_id, toxic, text`` of the sample, and how many training rows carry each label."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = stage(known.withColumn("_h", F.xxhash64(F.lit("example"), "_id")), "toxicity-labels")
    totals = {int(r["toxic"]): r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picks = [known.filter(F.col("toxic") == y).orderBy("_h", "_id").limit(per_class) for y in (0, 1)]
    picked = stage(picks[0].union(picks[1]).select("_id", "toxic"), "toxicity-picked")
    found = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(
        F.broadcast(picked), F.col("doc_id") == F.col("_id")  # 2 * per_class rows at most
    )
    one = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return stage(one, "toxicity-examples"), totals


def term_weights(sample: DataFrame) -> dict[str, float]:
    """Each word of the examples and how far the classes' shares of examples with it lie apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if y else clean).update(set(WORD.findall(text.lower())))
            terms = list(toxic.keys() | clean.keys())
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.string()), pa.array([toxic[t] for t in part], pa.int64()), pa.array([clean[t] for t in part], pa.int64())],
                    names=["term", "toxic", "clean"],
                )

    n = {int(r["toxic"]): r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return {}
    counts = sample.select("toxic", "text").mapInArrow(run, "term string, toxic long, clean long")
    found = counts.groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).collect()  # words of 2 * per_class texts
    return dict(sorted((r["term"], apart(r["a"], r["b"], pos, neg)) for r in found))


def apart(a: int, b: int, pos: int, neg: int) -> float:
    """Absolute log ratio of a term's smoothed shares of ``pos`` toxic and ``neg`` clean examples; 0 for an unseen term."""
    share = SMOOTH / (pos + neg)
    return abs(math.log((a / pos + share) / (b / neg + share)))


class Reader:
    """Turns texts into counts of the examples' words."""

    def __init__(self, terms: list[str]):
        self.at = {t: i for i, t in enumerate(terms)}

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers, ascending, and their counts."""
        numbers = [i for i in map(self.at.get, WORD.findall((text or "").lower())) if i is not None]
        return np.unique(np.array(numbers, dtype=np.int64), return_counts=True)


def document_frequencies(docs: DataFrame, terms: list[str]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen, rows = Reader(terms), np.zeros(len(terms), dtype=np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                held = [reader.counts(text)[0] for text in batch.column(0).slice(at, SLICE).to_pylist()]
                seen += np.bincount(np.concatenate(held), minlength=len(terms))
                rows += len(held)
        found = np.flatnonzero(seen)
        term, n = np.append(found, -1), np.append(seen[found], rows)  # -1: the rows
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n)], names=["term", "n"])

    got = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = {r["term"]: r["n"] for r in got}  # a row per term at most
    return np.array([n.get(i, 0) for i in range(len(terms))], dtype=float), n.get(-1, 0)


# ---- index --------------------------------------------------------------


class BlockMaxIndex:
    """Unit vectors of examples in blocks; common terms as a matrix, of the others each block's highest weight per term."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, common: int = COMMON):
        self.n, self.n_terms = len(vectors), n_terms
        self.n_blocks = -(-self.n // BLOCK)
        none = [(np.empty(0, dtype=np.int64), np.empty(0))]
        owner = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        terms, weights = (np.concatenate(x) for x in zip(*(vectors or none), strict=True))
        often = np.bincount(terms, minlength=n_terms) * common >= max(1, self.n)
        self.column = np.where(often, np.cumsum(often) - 1, -1)  # of the matrix
        in_matrix = often[terms]
        self.matrix_parts = owner[in_matrix], self.column[terms[in_matrix]], weights[in_matrix]
        # postings of the other terms: by term, then by block
        key = (terms * max(1, self.n_blocks) + owner // BLOCK)[~in_matrix]
        order = np.argsort(key, kind="stable")
        key, self.owner, self.weights = key[order], owner[~in_matrix][order], weights[~in_matrix][order]
        first = np.flatnonzero(np.diff(key, prepend=-1))  # of each term's part in a block
        self.part_begin = np.append(first, len(key))
        self.part_block = key[first] % max(1, self.n_blocks)
        self.part_most = np.maximum.reduceat(self.weights, first) if len(first) else np.empty(0)
        self.term_begin = np.searchsorted(key[first], np.arange(n_terms + 1) * max(1, self.n_blocks))
        self._matrix: np.ndarray | None = None

    def matrix(self) -> np.ndarray:
        """Common terms by examples; made once per process, the examples filled up to whole blocks."""
        if self._matrix is None:
            rows, columns, weights = self.matrix_parts
            self._matrix = np.zeros((int(self.column.max(initial=-1)) + 1, self.n_blocks * BLOCK))
            self._matrix[columns, rows] = weights
        return self._matrix

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest with a cosine above 0, ties to the smaller number."""
        return self.nearest_of([(terms, weights)], k)[0]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of several queries."""
        matrix = self.matrix()
        asked = np.zeros((len(queries), len(matrix)))
        for q, (terms, weights) in enumerate(queries):
            column = self.column[terms]
            asked[q, column[column >= 0]] = weights[column >= 0]
        parts = asked @ matrix
        tops = parts.reshape(len(queries), self.n_blocks, BLOCK).max(axis=2)
        out = []
        for (terms, weights), part, top in zip(queries, parts, tops, strict=True):
            rare = self.column[terms] < 0
            out.append(self._visit(terms[rare], weights[rare], part, top, k))
        return out

    def _visit(self, terms: np.ndarray, weights: np.ndarray, cosines: np.ndarray, top: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``cosines`` and their maxima ``top`` per block hold the matrix's part; ``terms`` are the others."""
        size = self.term_begin[terms + 1] - self.term_begin[terms]
        parts, weight = _ranges(self.term_begin[terms], size), np.repeat(weights, size)
        block = self.part_block[parts]
        bound = top + np.bincount(block, self.part_most[parts] * weight, minlength=self.n_blocks)
        ids, sims, least = np.empty(0, dtype=int), np.empty(0), 0.0
        order = np.argsort(-bound, kind="stable")
        done, width = 0, 2
        while done < len(order):  # 2, 8, 32, ... blocks, so that few rounds are needed
            some = order[done : done + width]
            some = some[bound[some] >= least - 1e-11] if len(ids) >= k else some[bound[some] > 0]
            if not len(some):
                break
            chosen = np.zeros(self.n_blocks, dtype=bool)
            chosen[some] = True
            mine = np.flatnonzero(chosen[block])
            begin, n = self.part_begin[parts[mine]], self.part_begin[parts[mine] + 1] - self.part_begin[parts[mine]]
            entries = _ranges(begin, n)
            got = cosines + np.bincount(self.owner[entries], self.weights[entries] * np.repeat(weight[mine], n), minlength=len(cosines))
            hit = np.flatnonzero((got > 0) & (got >= least - 1e-11) & np.repeat(chosen, BLOCK))
            ids, sims = np.concatenate([ids, hit]), np.concatenate([sims, np.round(got[hit], 12)])
            if len(ids) > k:
                best = np.lexsort((ids, -sims))[:k]
                ids, sims = ids[best], sims[best]
            if len(ids) >= k:
                least = sims.min()
            done, width = done + width, width * 4
        best = np.lexsort((ids, -sims))
        return ids[best], sims[best]


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Model:
    """Weights, index and votes; bounded by the words of PER_CLASS texts per label."""

    def __init__(self, weights: dict[str, float], df: np.ndarray, n_docs: int, rows: list[tuple], totals: dict[int, int]):
        """rows: (counts as flat list, toxic examples, clean examples, smallest doc_id) per distinct vector."""
        self.terms = list(weights)
        self.weigh = (np.log((1 + n_docs) / (1 + df)) + 1) * np.array(list(weights.values()), dtype=float)
        have = [sum(r[1] for r in rows), sum(r[2] for r in rows)]
        per = [totals.get(1, 0) / max(1, have[0]), totals.get(0, 0) / max(1, have[1])]
        all_toxic, all_n = totals.get(1, 0), totals.get(1, 0) + totals.get(0, 0)
        self.prior = all_toxic / all_n if all_n else 0.0
        vectors, votes, none, self.ids = [], [], [0.0, 0.0], []
        # blocks hold alike examples: by label, then by their heaviest term
        made = []
        for flat, toxic, clean, doc_id in rows:
            pairs = np.array(flat, dtype=np.int64).reshape(-1, 2)
            terms, w = self.vector(pairs[:, 0], pairs[:, 1])
            if len(terms):
                made.append((toxic * per[0] < clean * per[1], int(terms[np.argmax(w)]), list(flat), (terms, w), (toxic * per[0], clean * per[1]), doc_id))
            else:
                none = [none[0] + toxic * per[0], none[1] + clean * per[1]]
        for _, _, _, vector, vote, doc_id in sorted(made, key=lambda r: r[:3]):
            vectors.append(vector)
            votes.append(vote)
            self.ids.append(doc_id)
        self.toxic, self.clean = np.array(votes, dtype=float).reshape(-1, 2).T
        self.bare = (none[0] + PRIOR * self.prior) / (sum(none) + PRIOR)
        self.index = BlockMaxIndex(vectors, len(self.terms))

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms that weigh and their weights, of length 1 together."""
        w = (1 + np.log(counts)) * self.weigh[terms]
        terms, w = terms[w > 0], w[w > 0]
        return terms, w / math.sqrt(float((w * w).sum())) if len(w) else w

    def scores(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, str]]:
        """Share of toxic votes, and the nearest examples as doc_id:cosine, of each text."""
        vectors = [self.vector(*c) for c in counted]
        out = [(self.bare, "")] * len(vectors)
        asked = [i for i, (t, _) in enumerate(vectors) if len(t)]
        if not asked or not self.index.n:
            return out
        for i, (ids, sims) in zip(asked, self.index.nearest_of([vectors[i] for i in asked], NEAREST), strict=True):
            if len(ids):
                vote = (sims / sims[0]) ** SHARPNESS
                yes, no = float((vote * self.toxic[ids]).sum()), float((vote * self.clean[ids]).sum())
                near = ",".join(f"{self.ids[j]}:{s:.4f}" for j, s in zip(ids[:3].tolist(), sims[:3].tolist(), strict=True))
                out[i] = round(min(1.0, (yes + PRIOR * self.prior) / (yes + no + PRIOR)), 9), near
        return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learns from the labelled rows that aren't held out."""
    sample, totals = examples(docs, labels, per_class)
    weights = term_weights(sample)
    terms = list(weights)
    df, n_docs = document_frequencies(docs, terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(terms)
        for batch in batches:
            flat = [np.stack(reader.counts(t), 1).ravel().tolist() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flat, pa.list_(pa.int64()))], names=["doc_id", "toxic", "counts"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    vectors = sample.select("doc_id", "toxic", "text").mapInArrow(run, f"doc_id {kind}, toxic int, counts array<long>")
    grouped = vectors.groupBy("counts").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"), F.min("doc_id").alias("id"))
    rows = [(r["counts"], r["t"], r["c"], r["id"]) for r in grouped.collect()]  # 2 * per_class rows at most
    return Model(weights, df, n_docs, rows, totals)


# ---- scoring ------------------------------------------------------------


class Scorer:
    def __init__(self, model: Model):
        self.model, self.reader = model, Reader(model.terms)

    def __call__(self, text: str | None) -> tuple[float, str]:
        return self.each([text])[0]

    def each(self, texts: list[str | None]) -> list[tuple[float, str]]:
        return self.model.scores([self.reader.counts(t) for t in texts])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` for every row of ``docs(doc_id, text)``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded, see Model
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                got = scorer.each(part.column(2).to_pylist())
                score = np.array([s for s, _ in got], dtype=float)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array([e for _, e in got], pa.string())],
                    names=["doc_id", "held_out", "score", "predicted", "evidence"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, evidence string")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is below one half."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                keep = [s < 0.5 for s, _ in scorer.each(part.column(text_at).to_pylist())]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
