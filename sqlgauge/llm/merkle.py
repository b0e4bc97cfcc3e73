"""Merkle manifest of a table: digests of rows, their subtree and root, proofs, and checks of tampered rows.

A sequence of nodes is folded two by two. It is cut into aligned superblocks of 4,096 nodes, and a superblock
is the only group that a task holds:

* upwards, each superblock is reduced to one node; the nodes of all superblocks are a sequence again, that
  much shorter, until each sequence is one node, its subroot. The subroots are folded alike to the root;
* downwards, the members of a superblock are cogrouped with the outer nodes that their proofs need (the way from
  the superblock's node to the root). One function call finishes the local reduction, joins the local proof with
  the outer one, and folds leaves, original or tampered, to the root they give.

Only digests are shuffled. Positions come from a range sort with counts by part, so a sequence that holds any
share of the rows is spread over all tasks.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sqlgauge.llm.common import materialize, table

#: Levels that a superblock folds; it has two to that power of nodes.
LEVELS = 12

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODES = "seq string, at bigint, total bigint, digest string"
_WAYS = "seq string, at bigint, way string"


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(c: Column) -> Column:
    """A value with its length in bytes; ``-`` for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def sequence_key(c: Column) -> Column:
    """A text never null that sorts as ``c`` does, null first."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


# --- positions -------------------------------------------------------------------------------

def numbered(rows: DataFrame, name: str, *order: Column | str) -> tuple[DataFrame, int]:
    """Add ``at`` (from 0, in each ``seq``) and ``total`` (rows of the ``seq``); with the greatest total.

    Rows are range-sorted over all tasks; a task counts its rows of each sequence, and the counts of the tasks
    before it are its offset.
    """
    placed = materialize(
        rows.repartitionByRange("seq", *order).sortWithinPartitions("seq", *order)
        .withColumn("_rid", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_rid", 33)), name)
    parts = placed.groupBy("seq", "_part").agg(F.min("_rid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("seq").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn(
        "total", F.sum("_n").over(Window.partitionBy("seq"))), f"{name}-parts")
    most = parts.agg(F.max("total")).first()[0] or 0
    return placed.join(parts, ["seq", "_part"]).withColumn(
        "at", F.col("_before") + F.col("_rid") - F.col("_first")).drop(
        "_rid", "_part", "_first", "_n", "_before"), most


# --- superblocks -----------------------------------------------------------------------------

def _levels(total: int, most: int) -> int:
    """Levels that a superblock of a sequence of ``total`` nodes folds: ``most``, or until one node is left."""
    return min(most, max(total - 1, 0).bit_length())


def _fold(nodes: list[str], levels: int) -> list[list[str]]:
    """Nodes of each level, the given ones first."""
    found = [nodes]
    for _ in range(levels):
        low = found[-1]
        found.append([_h("".join(low[i:i + 2])) for i in range(0, len(low), 2)])
    return found


def _local_way(found: list[list[str]], at: int) -> str:
    """Way of a member to its superblock's node: ``L`` or ``R`` and the sibling on that side, ``S`` if alone."""
    steps = []
    for level in found[:-1]:
        other = at ^ 1
        steps.append("S" if other >= len(level) else ("L" if other < at else "R") + level[other])
        at >>= 1
    return "".join(steps)


def _siblings(way: str) -> str:
    return way.replace("L", "").replace("R", "").replace("S", "")


def _climb(digest: str, way: str) -> str:
    """Root that a digest gives with the siblings of its way."""
    i, end = 0, len(way)
    while i < end:
        side = way[i]
        if side == "S":
            digest, i = _h(digest), i + 1
        else:
            other = way[i + 1:i + 65]
            digest, i = _h(other + digest if side == "L" else digest + other), i + 65
    return digest


def _members(group: pd.DataFrame, levels: int) -> tuple[pd.DataFrame, list[list[str]]]:
    group = group.sort_values("at")
    return group, _fold(group["digest"].tolist(), _levels(int(group["total"].iloc[0]), levels))


def _block(levels: int) -> Column:
    return F.shiftright("at", levels).alias("block")


def reduced(nodes: DataFrame, levels: int) -> DataFrame:
    """The superblocks' nodes, as sequences of their own."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group, found = _members(group, levels)
        total = -(-int(group["total"].iloc[0]) >> levels)
        return pd.DataFrame({"seq": [key[0]], "at": [key[1]], "total": [total], "digest": [found[-1][0]]})

    return nodes.select("seq", "at", "total", "digest").groupBy("seq", _block(levels)).applyInPandas(run, _NODES)


def ways(nodes: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """Way to the root of each node: its local one and its superblock's (``outer``: ``seq, at, way``)."""

    mask = (1 << levels) - 1

    def run(key: tuple, group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group, found = _members(group, levels)
        rest = above["way"].iloc[0]
        local = [_local_way(found, int(at) & mask) + rest for at in group["at"]]
        return pd.DataFrame({"seq": key[0], "at": group["at"].to_numpy(), "way": local})

    return (nodes.select("seq", "at", "total", "digest").groupBy("seq", _block(levels))
            .cogroup(outer.groupBy("seq", "at")).applyInPandas(run, _WAYS))


def _tower(nodes: DataFrame, most: int, levels: int, name: str) -> list[DataFrame]:
    """Sequences of ``most`` nodes at most, their superblocks' nodes, and so on until each sequence is one node."""
    found = [nodes]
    while most > 1:
        found.append(materialize(reduced(found[-1], levels), f"{name}-{len(found)}"))
        most = -(-most >> levels)
    return found


def _down(tower: list[DataFrame], top: DataFrame, levels: int, name: str) -> DataFrame:
    """Ways of a tower's nodes above the lowest floor, from those of its top."""
    for no in range(len(tower) - 2, 0, -1):
        top = materialize(ways(tower[no], top, levels), f"{name}-ways")
    return top


# --- the manifest ----------------------------------------------------------------------------

_RESULT = ("doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
           "verified boolean")


def _finished(leaves: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """Leaves and the outer nodes of their superblock, cogrouped: proofs, and roots folded from what is held."""

    mask = (1 << levels) - 1

    def run(key: tuple, group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group, found = _members(group, levels)
        rest, subroot, root = (above[c].iloc[0] for c in ("way", "subroot", "root"))
        proofs, folded = [], []
        for at, held in zip(group["at"], group["held"]):
            way = _local_way(found, int(at) & mask) + rest
            proofs.append(_h(_siblings(way)))
            folded.append(_climb(held, way))
        out = pd.DataFrame({"doc_id": group["doc_id"], "leaf": group["digest"], "subroot": subroot,
                            "root": root, "proof_sha256": proofs, "folded_root": folded})
        out["verified"] = out["folded_root"] == root
        return out

    # identifiers travel as text: pandas would make floating-point numbers of those beside a null
    found = leaves.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("seq", _block(levels)).cogroup(
        outer.groupBy("seq", "at")).applyInPandas(run, _RESULT)
    return found.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def manifest(docs: DataFrame, every: int = 7, levels: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row of ``docs``.

    A leaf is the digest of a row's identifier, source, language, length and whole text, null told from empty.
    Leaves of a language ascend by ``doc_id`` (null first; repeated rows by their leaf, equal rows in any
    order), languages by their bytes, null first. The row's ``n_chars`` is one greater, as if tampered with,
    where ``every`` divides the crc32 of its identifier (not for null ones): its folded root differs from the
    root, every other one equals it. A single row is its own root and has the digest of the empty text as
    proof. An empty table gives an empty result; other columns are not read.
    """
    c = {name: F.col(name) for name in FIELDS}
    tampered = F.coalesce(F.crc32(c["doc_id"].cast("string")) % every == 0, F.lit(False)) & c["n_chars"].isNotNull()
    # beyond the greatest long the number goes on, as a decimal
    changed = (c["n_chars"].cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    rows = docs.select(
        sequence_key(c["lang"]).alias("seq"), c["doc_id"].cast("bigint").alias("doc_id"),
        leaf(*c.values()).alias("digest"),
        F.when(tampered, leaf(c["doc_id"], c["source"], c["lang"], changed, c["text"])).alias("held"))
    leaves, most = numbered(rows, "leaves", "doc_id", "digest")
    leaves = leaves.withColumn("held", F.coalesce("held", "digest"))
    trees = _tower(leaves, most, levels, "subtrees")
    subroots = trees[-1].select(F.lit("").alias("seq"), F.col("seq").alias("name"), F.col("digest"))
    names, most = numbered(subroots, "subroots", "name")
    crown = _tower(names, most, levels, "crown")
    top = crown[-1].first()

    # ways of the languages' subroots
    way = crown[-1].select("seq", "at", F.lit("").alias("way"))
    if len(crown) > 1:
        way = ways(names, _down(crown, way, levels, "crown"), levels)
    tops = materialize(names.join(way, ["seq", "at"]).select(
        F.col("name").alias("seq"), F.lit(0).cast("bigint").alias("at"), "way", F.col("digest").alias("subroot"),
        F.lit(top and top["digest"]).cast("string").alias("root")), "tops")
    if len(trees) == 1:
        # no language has a second leaf: each leaf is its subroot
        return _finished(leaves, tops, levels)
    outer = _down(trees, tops.select("seq", "at", "way"), levels, "subtrees")
    outer = outer.join(tops.select("seq", "subroot", "root"), "seq")
    return _finished(leaves, outer, levels)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
_LEAF = " || ".join(_FIELD.format(c) for c in FIELDS)
_TAMPERED = " || ".join(_FIELD.format("(n_chars + 1)" if c == "n_chars" else c) for c in FIELDS)
# bit by bit, from the digits of the identifier
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _sql_tower(name: str, nodes: str) -> str:
    """All nodes ``(seq, lvl, i, h)`` above those of level 0, until one is left in each sequence."""
    return f"""{name} AS (SELECT seq, 0 AS lvl, i, h FROM {nodes} UNION ALL
  SELECT seq, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY seq) AS n FROM {name}) WHERE n > 1
  GROUP BY seq, lvl, i // 2)"""


def _sql_steps(name: str, members: str, tower: str) -> str:
    """The way of each member through its tower, as texts: side and sibling, level by level."""
    return f"""{name} AS (SELECT m.r, list(CASE WHEN s.h IS NULL THEN 'S' WHEN s.i < m.i >> u.lvl THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY u.lvl) AS steps
  FROM {members} m JOIN (SELECT seq, lvl, max(lvl) OVER (PARTITION BY seq) AS top FROM {tower} GROUP BY seq, lvl) u ON u.seq = m.seq AND u.lvl < u.top
  LEFT JOIN {tower} s ON s.seq = m.seq AND s.lvl = u.lvl AND s.i = xor(m.i >> u.lvl, 1) GROUP BY m.r)"""


SQL = f"""
WITH RECURSIVE rows AS (SELECT *, row_number() OVER () AS r, coalesce('=' || lang, '') AS seq, sha256({_LEAF}) AS h,
  CASE WHEN n_chars IS NOT NULL AND {_CRC} % 7 = 0 THEN sha256({_TAMPERED}) ELSE sha256({_LEAF}) END AS held FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM rows),
{_sql_tower('up', 'leaves')},
subroots AS (SELECT seq AS name, arg_max(h, lvl) AS h FROM up WHERE i = 0 GROUP BY seq),
names AS (SELECT '' AS seq, name, name AS r, h, row_number() OVER (ORDER BY name) - 1 AS i FROM subroots),
{_sql_tower('crown', 'names')},
top AS (SELECT arg_max(h, lvl) AS root FROM crown WHERE i = 0),
{_sql_steps('low', 'leaves', 'up')},
{_sql_steps('high', 'names', 'crown')},
ways AS (SELECT l.doc_id, l.h AS leaf, l.held, s.h AS subroot, root, list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) AS steps
  FROM leaves l JOIN subroots s ON s.name = l.seq CROSS JOIN top LEFT JOIN low a ON a.r = l.r LEFT JOIN high b ON b.r = l.seq),
folded AS (SELECT *, sha256(list_aggregate(list_prepend('', list_transform(steps, lambda x: x[2:])), 'string_agg', '')) AS proof_sha256,
  list_reduce(list_prepend(held, steps), lambda h, x: CASE x[1] WHEN 'L' THEN sha256(x[2:] || h) WHEN 'R' THEN sha256(h || x[2:]) ELSE sha256(h) END) AS folded_root FROM ways)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
