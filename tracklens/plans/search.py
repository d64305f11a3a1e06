"""Search over an index instead of every column of every row.

The index holds one row per place where a word of a table row starts: the
text from there on (``TOKEN`` characters, small letters) and the row's
number, sorted by that text.  A term's matches are then one range of the
index, which the statistics of the stored files narrow to a few row groups;
the rows that every term hits are found by counting terms per row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.functions.labels import search_terms
from tracklens.plans.rollups import raw_search, search_texts

TOKEN = 16
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _small(c: Column) -> Column:
    """ASCII letters as small ones, which is what the search takes as equal."""
    return F.translate(c, CAPITALS, CAPITALS.lower())


def _word_starts(text: Column) -> Column:
    """The text from every word start on: its beginning, and whatever follows neither a letter nor a hyphen."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    starts = F.filter(places, lambda i: (i == 1) | ~F.substring(text, i - 1, 1).rlike(r"[\p{L}\-]"))
    return F.transform(starts, lambda i: F.substring(text, i, TOKEN))


def _behind(start: str) -> str | None:
    """The least text above all that start with ``start``; None if there is no such text."""
    while start and start[-1] == chr(0x10FFFF):
        start = start[:-1]
    if not start:
        return None
    code = ord(start[-1]) + 1
    return start[:-1] + chr(0xE000 if code == 0xD800 else code)  # no text holds surrogates


class SearchIndex:
    """A stored table with its index; ``rows`` and ``tokens`` are read back from ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = spark.read.parquet(f"{path}/rows")
        self.tokens = spark.read.parquet(f"{path}/tokens")

    @classmethod
    def build(cls, table: DataFrame, root: str) -> SearchIndex:
        """Store ``table`` and its index under a new folder of ``root``."""
        path = f"{root.rstrip('/')}/search-{uuid.uuid4().hex}"
        table.withColumn("_row", F.monotonically_increasing_id()).write.parquet(f"{path}/rows")
        spark = table.sparkSession
        rows = spark.read.parquet(f"{path}/rows")
        texts = F.array(*[_small(t) for t in search_texts(table)])
        starts = F.array_distinct(F.flatten(F.transform(texts, _word_starts)))
        tokens = rows.select(F.explode(starts).alias("token"), "_row").where("token <> ''")
        tokens.repartitionByRange("token", "_row").sortWithinPartitions("token", "_row").write.parquet(f"{path}/tokens")
        return cls(spark, path)

    def matches(self, term: str) -> DataFrame:
        """Numbers of the rows with a word that starts with the term's first ``TOKEN`` characters: one range of the index."""
        start = "".join(c.lower() if c in CAPITALS else c for c in term)[:TOKEN]
        behind = _behind(start)
        inside = F.col("token") >= start
        if behind is not None:
            inside &= F.col("token") < behind
        return self.tokens.where(inside).select("_row").distinct()

    def search(self, query: str) -> DataFrame:
        """The rows :func:`tracklens.plans.rollups.raw_search` gives for ``query``."""
        terms = search_terms(query)
        if not terms:
            return self.table.drop("_row")
        hits = None
        for t in terms:
            m = self.matches(t)
            hits = m if hits is None else hits.union(m)
        every = hits.groupBy("_row").count().where(F.col("count") == len(terms)).select("_row")
        found = self.table.join(every, "_row", "left_semi").drop("_row")
        # a term longer than what is stored is compared with the few rows that start like it
        return raw_search(found, query) if any(len(t) > TOKEN for t in terms) else found
