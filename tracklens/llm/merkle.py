"""Merkle manifest of a dataset, and proofs checked by a recursive climb.

Every document is a leaf digest. Per source the leaves, ordered by doc_id,
form a tree whose nodes are digests of ``RUN`` consecutive nodes; the
subroots, ordered by source, form one more tree up to the root. Levels are
built one after the other, each from the level below it, and stored as node
rows: a node's place, the digests of its run before and behind it, and the
place of its parent.

Proofs come from a recursive query over those rows. It starts at the leaves
and joins each row to the node it stands at, appends that node's siblings to
the proof, folds the claimed digest with them and goes on at the parent, until
there is none. Leaves whose paths meet after ``INNER`` levels travel in one
row (a block of ``RUN ** INNER``): every leaf has a fold of its own, the
siblings above the block are the same for all of them and are kept once.

The order within a source is a range partition of all rows, and a block or a
run is a group of its own, so a source of any size is spread over all tasks.

Defined results: equal doc_ids of a source are ordered by their leaf digests;
a NULL doc_id comes first and is never tampered with; repeated rows are leaves
of their own; a NULL source is a source; a lone leaf is its subroot, a lone
subroot the root, and a proof without siblings the digest of the empty text;
an empty table gives an empty manifest.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm.common import in_order, running_before, stage, unstage

RUN = 3
INNER = 3  # levels within a block
BLOCK = RUN**INNER
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SOURCES = -1  # the number of the tree above the subroots
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


# ---- digests ------------------------------------------------------------


def field_text(value: Column) -> Column:
    """``-`` for NULL, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column | None = None) -> Column:
    """The digest of a document, or of the same document with another ``text``."""
    values = [F.col(f) if text is None or f != "text" else text for f in FIELDS]
    return F.sha2(F.concat(*map(field_text, values)), 256)


def tampered_digest() -> Column:
    """The digest as a claimant gives it: every other doc_id (by checksum) has lost its line breaks."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(hit, leaf_digest(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).otherwise(leaf_digest())


def digest_of(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


def level_above(nodes: Column) -> Column:
    """The digests one level above an array of digests."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / RUN).cast("int"))
    return F.transform(runs, lambda r: digest_of(F.slice(nodes, r * RUN + 1, RUN)))


def siblings(nodes: Column, at: Column) -> tuple[Column, Column]:
    """What stands before and behind the node number ``at`` in its run, as text."""
    first = F.floor(at / RUN).cast("int") * RUN
    before = F.array_join(F.slice(nodes, first + 1, at - first), "")
    after = F.array_join(F.slice(nodes, at + 2, first + RUN - 1 - at), "")
    return before, after


# ---- building -----------------------------------------------------------


@dataclass
class Manifest:
    """``blocks(tree, block, members, up_*)``, ``nodes`` (parent-linked), ``subroots(tree, source, subroot)`` and the root."""

    blocks: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: str | None


def source_table(leaves: DataFrame) -> DataFrame:
    """``source, n, tree``: the leaves of each source and its number in the order of the sources."""
    counted = leaves.groupBy("source").agg(F.count("*").alias("n"))
    ranked = running_before(in_order(counted, ["source"], "merkle-order").withColumn("_all", F.lit(0)), "_all", F.lit(1))
    return stage(ranked.select("source", "n", F.col("_before").alias("tree")), "merkle-sources")


def folded(nodes: Column, level: int):
    """A step of all members of a block past ``nodes``, its digests on ``level``."""

    def step(member: Column, i: Column) -> Column:
        before, after = siblings(nodes, F.floor(i / RUN**level).cast("int"))
        return F.struct(
            member["doc_id"].alias("doc_id"),
            member["leaf"].alias("leaf"),
            F.sha2(F.concat(before, member["fold"], after), 256).alias("fold"),
            F.concat(member["proof"], before, after).alias("proof"),
        )

    return step


def block_table(ordered: DataFrame, sources: DataFrame) -> DataFrame:
    """Blocks of leaves with their inner levels: ``members`` hold doc_id, leaf, fold and the siblings in the block."""
    placed = running_before(ordered, "source", F.lit(1))
    member = F.struct(F.col("_before").alias("i"), "doc_id", "leaf", "claimed")
    groups = placed.groupBy(F.col("source").alias("_s"), F.expr(f"_before div {BLOCK}").alias("block")).agg(
        F.array_sort(F.collect_list(member)).alias("m")
    )
    rows = groups.join(sources, F.col("_s").eqNullSafe(F.col("source"))).select("tree", "n", "block", "m")
    rows = rows.withColumn("h0", F.transform("m", lambda x: x["leaf"])).withColumn(
        "m0",
        F.transform("m", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["leaf"].alias("leaf"), x["claimed"].alias("fold"), F.lit("").alias("proof"))),
    )
    for k in range(INNER):  # a source of RUN ** k leaves or fewer has no level k + 1
        deeper, nodes = F.col("n") > RUN**k, F.col(f"h{k}")
        rows = rows.withColumn(f"m{k + 1}", F.when(deeper, F.transform(f"m{k}", folded(nodes, k))).otherwise(F.col(f"m{k}")))
        rows = rows.withColumn(f"h{k + 1}", F.when(deeper, level_above(nodes)).otherwise(nodes))
    return rows.select(
        "tree", "block", F.col(f"m{INNER}").alias("members"), F.element_at(f"h{INNER}", 1).alias("digest"),
        F.ceil(F.col("n") / BLOCK).alias("nodes"),
    )


def parent(tree: Column, level: int, up: Column, nodes: Column, trees: int) -> list[Column]:
    """Place of the parent on ``level`` if that has ``nodes`` nodes: NULL for the root, a leaf of the upper tree for subroots."""
    own, sub = nodes > 1, (tree >= 0) & (F.lit(trees) > 1)
    return [
        F.when(own, tree).when(sub, F.lit(SOURCES)).cast("long").alias("up_tree"),
        F.when(own, F.lit(level)).when(sub, F.lit(0)).alias("up_level"),
        F.when(own, up).when(sub, tree).cast("long").alias("up_at"),
    ]


def climb_levels(bottom: DataFrame, trees: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """All levels above ``bottom(tree, at, nodes, digest)``: their node rows, and ``tree, digest`` of the tops."""
    links, tops, level = [], [], 0
    while True:
        tops.append(bottom.filter("nodes = 1").select("tree", "digest"))
        if not bottom.filter("nodes > 1").head(1):
            break
        kid = F.struct("at", "digest")
        runs = stage(
            bottom.filter("nodes > 1")
            .groupBy("tree", "nodes", F.expr(f"at div {RUN}").alias("up"))
            .agg(F.array_sort(F.collect_list(kid)).alias("kids"))
            .select("tree", "up", "kids", F.ceil(F.col("nodes") / RUN).alias("nodes"), digest_of(F.col("kids.digest")).alias("digest")),
            f"merkle-{name}-{level}",
        )
        before, after = siblings(F.col("kids.digest"), F.col("i"))
        links.append(
            runs.select("*", F.posexplode("kids").alias("i", "kid")).select(
                "tree", F.lit(level).alias("level"), F.col("kid.at").alias("at"), before.alias("before"), after.alias("after"),
                *parent(F.col("tree"), level + 1, F.col("up"), F.col("nodes"), trees),
            )
        )
        bottom = runs.select("tree", F.col("up").alias("at"), "nodes", "digest")
        level += 1
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return links, out


def build(docs: DataFrame, claimed: Column | None = None) -> Manifest:
    """The manifest of ``docs``; ``claimed`` is the leaf digest to be checked, by default the leaf's own."""
    leaf = leaf_digest()
    rows = docs.select("doc_id", "source", leaf.alias("leaf"), (leaf if claimed is None else claimed).alias("claimed"))
    ordered = in_order(rows, ["source", "doc_id", "leaf", "claimed"], "merkle-leaves")
    sources = source_table(ordered)
    trees = sources.count()
    blocks = stage(block_table(ordered, sources), "merkle-blocks")
    links, tops = climb_levels(blocks.select("tree", F.col("block").alias("at"), "nodes", "digest"), trees, "trees")
    subroots = stage(tops.join(sources.select("tree", "source"), "tree").withColumnRenamed("digest", "subroot"), "merkle-subroots")
    upper = subroots.select(
        F.lit(SOURCES).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(trees).cast("long").alias("nodes"), F.col("subroot").alias("digest")
    )
    more, top = climb_levels(upper, trees, "sources")
    root = top.first()
    nodes = None
    for link in [*links, *more]:
        nodes = link if nodes is None else nodes.union(link)
    if nodes is None:  # no run anywhere: a node table without rows
        kinds = "tree long, level int, at long, before string, after string, up_tree long, up_level int, up_at long"
        nodes = docs.sparkSession.createDataFrame([], kinds)
    unstage(ordered)
    bottom = parent(F.col("tree"), 0, F.col("block"), F.col("nodes"), trees)
    return Manifest(blocks.select("*", *bottom), stage(nodes, "merkle-nodes"), subroots, root["digest"] if root else None)


# ---- proofs -------------------------------------------------------------

CLIMB = """
WITH RECURSIVE climb(tree, block, up_tree, up_level, up_at, folds, proof) AS (
  SELECT tree, block, up_tree, up_level, up_at, members.fold, '' FROM {blocks}
  UNION ALL
  SELECT c.tree, c.block, n.up_tree, n.up_level, n.up_at,
         transform(c.folds, f -> sha2(concat(n.before, f, n.after), 256)),
         concat(c.proof, n.before, n.after)
  FROM climb c JOIN {nodes} n ON n.tree = c.up_tree AND n.level = c.up_level AND n.at = c.up_at
)
SELECT tree, block, folds, proof FROM climb WHERE up_tree IS NULL
"""


@contextmanager
def whole_recursion(spark: SparkSession) -> Iterator[None]:
    """Recursive queries without Spark's limit on their rows; the levels of a tree bound the recursion."""
    old = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.set(ROW_LIMIT, old)


def proofs(manifest: Manifest) -> DataFrame:
    """``doc_id, source, leaf, subroot, root, proof, folded_root, verified`` of every leaf; ``proof`` is the siblings' text."""
    spark = manifest.blocks.sparkSession
    with whole_recursion(spark):  # the limit is read when the recursion runs, so its result is staged here
        paths = stage(spark.sql(CLIMB, blocks=manifest.blocks, nodes=manifest.nodes), "merkle-paths")
    whole = manifest.blocks.select("tree", "block", "members").join(paths, ["tree", "block"]).join(manifest.subroots, "tree")
    root = F.lit(manifest.root).cast("string")
    one = whole.select("source", "subroot", F.col("proof").alias("upper"), "folds", F.posexplode("members").alias("i", "m"))
    folded = F.element_at("folds", F.col("i") + 1)
    return one.select(
        F.col("m.doc_id").alias("doc_id"), "source", F.col("m.leaf").alias("leaf"), "subroot", root.alias("root"),
        F.concat("m.proof", "upper").alias("proof"), folded.alias("folded_root"), (folded == root).alias("verified"),
    )


def verified(docs: DataFrame) -> DataFrame:
    """The proofs of all documents, checked against their tampered digests, with the proof as its digest."""
    found = proofs(build(docs, tampered_digest()))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


# ---- the same in SQL ----------------------------------------------------

POLYNOMIAL = 0xEDB88320  # fixed value: the reversed polynomial of CRC-32
ALL_BITS = 0xFFFFFFFF


def oracle(levels: int = 16, source_levels: int = 10) -> str:
    """DuckDB SQL for the query's rows, for up to 3 ** ``levels`` documents of a source; every level is a CTE."""

    def text(value: str) -> str:
        return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"

    def digest(value: str) -> str:
        return "sha256(" + " || ".join(text(value if f == "text" else f) for f in FIELDS) + ")"

    bits = "SELECT i, i AS r FROM range(256) t(i)"
    for _ in range(8):
        bits = f"SELECT i, xor(r >> 1, CASE WHEN r & 1 = 1 THEN {POLYNOMIAL} ELSE 0 END) AS r FROM ({bits})"
    ctes = [
        f"crc AS (SELECT list(r ORDER BY i) AS t FROM ({bits}))",
        f"""sums AS (SELECT documents.*, xor(list_reduce(list_prepend({ALL_BITS}, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
            lambda ch: CAST(ascii(ch) AS BIGINT))), lambda r, b: xor(r >> 8, t[(xor(r, b) & 255) + 1])), {ALL_BITS}) AS c FROM documents, crc)""",
        f"""hashed AS (SELECT doc_id, source, {digest("text")} AS leaf,
            CASE WHEN c % 2 = 0 THEN {digest("replace(text, chr(10), '')")} ELSE {digest("text")} END AS claimed FROM sums)""",
        """leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS pos,
            dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM hashed)""",
        "l0 AS MATERIALIZED (SELECT tree, pos, leaf AS digest FROM leaves)",
        "p0 AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, leaf, tree, pos, claimed AS fold, '' AS proof FROM leaves)",
    ]

    def climb(first: int, last: int) -> None:
        for k in range(first, last):
            ctes.append(
                f"r{k} AS MATERIALIZED (SELECT tree, pos // {RUN} AS up, list(digest ORDER BY pos) AS kids, max(n) AS n"
                f" FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM l{k}) GROUP BY ALL)"
            )
            ctes.append(
                f"l{k + 1} AS MATERIALIZED (SELECT tree, up AS pos, CASE WHEN n = 1 THEN kids[1] ELSE sha256(array_to_string(kids, '')) END AS digest FROM r{k})"
            )
            before, after = f"array_to_string(kids[1:pos % {RUN}], '')", f"array_to_string(kids[pos % {RUN} + 2:], '')"
            ctes.append(
                f"p{k + 1} AS MATERIALIZED (SELECT id, doc_id, leaf, tree, pos // {RUN} AS pos,"
                f" CASE WHEN n = 1 THEN fold ELSE sha256({before} || fold || {after}) END AS fold,"
                f" CASE WHEN n = 1 THEN proof ELSE proof || {before} || {after} END AS proof"
                f" FROM p{k} JOIN r{k} USING (tree) WHERE up = pos // {RUN})"
            )

    climb(0, levels)
    ctes.append(f"subroots AS MATERIALIZED (SELECT tree, digest AS subroot FROM l{levels})")
    ctes.append(f"l{levels + 1} AS MATERIALIZED (SELECT 0 AS tree, tree AS pos, subroot AS digest FROM subroots)")
    ctes.append(f"p{levels + 1} AS MATERIALIZED (SELECT id, doc_id, leaf, 0 AS tree, tree AS pos, fold, proof FROM p{levels})")
    last = levels + 1 + source_levels
    climb(levels + 1, last)
    return (
        "WITH "
        + ",\n".join(ctes)
        + f"""
SELECT p.doc_id, p.leaf, subroot, digest AS root, sha256(p.proof) AS proof_sha256, p.fold AS folded_root, p.fold = digest AS verified
FROM p{last} p JOIN p0 USING (id) JOIN subroots ON subroots.tree = p0.tree CROSS JOIN l{last}"""
    )
