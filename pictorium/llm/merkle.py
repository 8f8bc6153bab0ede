"""Merkle manifest of a dataset by subtree exchange.

Rows are leaves. The leaves of a group stand in order, and while a group has
several nodes, runs of ``fan_out`` consecutive ones become their digest; what
remains is the group's subroot, and the subroots, ordered by group, are the
leaves of a last tree of the same kind. Digests go into digests as hexadecimal
text.

A superblock holds ``fan_out ** height`` consecutive nodes of a group. On the
way up each superblock is reduced to its top in a task of its own, and the tops
are the nodes of the next storey, until every group has one. On the way down
each superblock is cogrouped with the one outer row that it needs: the siblings
that its top has on the path to the root. The same function reduces the
superblock, joins the siblings inside to those outside and folds each claimed
leaf up to the root. No group holds more than a superblock, whatever share of
the rows one language has, and storeys shrink by the size of a superblock.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pictorium.llm import common
from pictorium.operators import ordering
from pictorium.session import ship_package

# Levels of a superblock.
HEIGHT = 10
# Rows of a range when leaves are numbered.
RANGE_ROWS = 1 << 14
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: of each value its length in bytes, a colon and the value as text, or a hyphen for null."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def digest(*nodes: str) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def storeys(nodes: list[str], fan_out: int, least: int) -> list[list[str]]:
    """The levels of a superblock from its nodes up to a single one, ``least`` of them above the nodes."""
    levels = [nodes]
    while len(levels[-1]) > 1 or len(levels) <= least:
        below = levels[-1]
        levels.append([digest(*below[i:i + fan_out]) for i in range(0, len(below), fan_out)])
    return levels


def paths(levels: list[list[str]], fan_out: int) -> list[tuple[str, str]]:
    """For each lowest node its ``places`` (how many siblings before and after it, a digit each for a level) and siblings."""
    found = [("", "")]
    for level in reversed(levels[:-1]):
        below = []
        for i in range(len(level)):
            run = level[i - i % fan_out:i - i % fan_out + fan_out]
            places, siblings = found[i // fan_out]
            at = i % fan_out
            below.append((f"{at}{len(run) - 1 - at}{places}", "".join(run[:at] + run[at + 1:]) + siblings))
        found = below
    return found


def fold(leaf: str, places: str, proof: str) -> str:
    """The root that a leaf and its siblings give."""
    at = 0
    for k in range(0, len(places), 2):
        before, after = at + 64 * int(places[k]), at + 64 * (int(places[k]) + int(places[k + 1]))
        leaf = digest(proof[at:before], leaf, proof[before:after])
        at = after
    return leaf


@dataclass
class Manifest:
    """Stored nodes of every storey, lowest first, of the groups' trees and of the tree of subroots."""

    groups: list[DataFrame]
    top: list[DataFrame]
    fan_out: int
    height: int

    def subroots(self) -> DataFrame:
        """``grp, subroot`` in the order of ``grp``; a group's name follows a plus sign, that of null is empty."""
        return self.groups[-1].select("grp", F.col("node").alias("subroot"))

    def root(self) -> str | None:
        """Digest of the whole table; null for an empty one."""
        row = self.top[-1].first()
        return row and row.node


def _blocks(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {size}"))


def _least(block: int, height: int) -> int:
    """Only the first superblock of a group may be lower than the others, and then it is the only one."""
    return height if block else 0


def _climb(nodes: DataFrame, fan_out: int, height: int) -> list[DataFrame]:
    """Stored storeys of ``grp, pos, node`` up to one node for each group."""

    def top(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        levels = storeys(rows.sort_values("pos")["node"].tolist(), fan_out, _least(key[1], height))
        return pd.DataFrame({"grp": [key[0]], "pos": [key[1]], "node": levels[-1]})

    found = [nodes]
    while (found[-1].agg(F.max("pos")).first()[0] or 0) > 0:
        above = _blocks(found[-1].select("grp", "pos", "node"), fan_out**height).groupBy("grp", "block")
        found.append(common.store(above.applyInPandas(top, "grp string, pos long, node string"), "merkle-nodes"))
    return found


def build(leaves: DataFrame, fan_out: int = 2, height: int = HEIGHT) -> Manifest:
    """The manifest of ``leaves``: ``grp, id, leaf, claimed``.

    ``grp`` may be null, and null comes first; names are ordered by their UTF-8
    bytes. Within a group leaves ascend by ``id``, null ids last, equal ids by
    ``leaf`` and ``claimed``, so repeated rows are leaves of their own and the
    root does not depend on the order of the input. An empty table has no root.
    """
    if not 2 <= fan_out <= 10:
        raise ValueError("fan_out is between 2 and 10")
    if height < 1:
        raise ValueError("a superblock has at least one level")
    ship_package(leaves.sparkSession)
    # Rows that are equal in all columns may stand in any order.
    rows = leaves.select(
        F.coalesce(F.concat(F.lit("+"), F.col("grp").cast("string")), F.lit("")).alias("grp"),
        F.col("id").cast("long").alias("id"), F.col("leaf").alias("node"), "claimed", F.monotonically_increasing_id().alias("row"),
    )
    rows = common.store(rows, "merkle-leaves")
    order = [("id", True), ("node", True), ("claimed", True), ("row", True)]
    placed = ordering.numbered(rows, order, ("grp",), "pos", RANGE_ROWS).withColumn("pos", F.col("pos") - 1).drop("row")
    groups = _climb(common.store(placed, "merkle-placed"), fan_out, height)
    subroots = ordering.numbered(groups[-1].select(F.col("grp").alias("name"), "node"), [("name", True)], name="pos")
    subroots = subroots.select(F.lit("").alias("grp"), (F.col("pos") - 1).alias("pos"), "node", "name")
    return Manifest(groups, _climb(common.store(subroots, "merkle-subroots"), fan_out, height), fan_out, height)


_OUTER = "grp string, pos long, name string, places string, proof string, subroot string, root string"
_RESULT = "id long, leaf string, subroot string, root string, places string, proof string, folded_root string, verified boolean"


def _descend(manifest: Manifest, nodes: DataFrame, outer: DataFrame, finish: bool = False) -> DataFrame:
    """Superblocks of nodes cogrouped with the path of their top: paths of the nodes, or finished leaves."""
    fan_out, height = manifest.fan_out, manifest.height

    def run(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, up = rows.sort_values("pos"), above.iloc[0]
        levels = storeys(rows["node"].tolist(), fan_out, _least(key[1], height))
        found = [(places + up["places"], proof + up["proof"]) for places, proof in paths(levels, fan_out)]
        places, proof = [p for p, _ in found], [s for _, s in found]
        if not finish:
            name = rows["name"] if "name" in rows else up["name"]
            return pd.DataFrame({"grp": key[0], "pos": rows["pos"], "name": name, "places": places, "proof": proof, "subroot": up["subroot"], "root": up["root"]})
        folded = [fold(*x) for x in zip(rows["claimed"], places, proof)]
        return pd.DataFrame({
            "id": rows["id"].astype("Int64"), "leaf": rows["node"], "subroot": up["subroot"], "root": up["root"], "places": places, "proof": proof,
            "folded_root": folded, "verified": [f == up["root"] for f in folded],
        })

    above = outer.withColumnRenamed("pos", "block").groupBy("grp", "block")
    return _blocks(nodes, fan_out**height).groupBy("grp", "block").cogroup(above).applyInPandas(run, _RESULT if finish else _OUTER)


def prove(manifest: Manifest) -> DataFrame:
    """Every leaf with its proof, and what its claimed digest folds to.

    ``id, leaf, subroot, root, places, proof, folded_root, verified``, a row for
    each leaf. ``proof`` holds the siblings in hexadecimal, level by level up to
    the root and left to right; ``places`` says for each level how many stand
    before and after the node. ``folded_root`` comes from ``claimed`` and the
    siblings alone, and ``verified`` says that it is the root.
    """
    top, groups = manifest.top, manifest.groups
    nothing = F.lit("")
    outer = top[-1].select("grp", "pos", nothing.alias("name"), nothing.alias("places"), nothing.alias("proof"), nothing.alias("subroot"), F.col("node").alias("root"))
    for nodes in reversed(top[:-1]):
        outer = common.store(_descend(manifest, nodes, outer), "merkle-paths")
    # A path in the tree of subroots is the outer path of a group's own tree.
    named = top[0].select("pos", F.col("name").alias("own"), F.col("node").alias("own_root"))
    outer = outer.join(named, "pos").select(F.col("own").alias("grp"), F.lit(0).cast("long").alias("pos"), "name", "places", "proof", F.col("own_root").alias("subroot"), "root")
    for nodes in reversed(groups[1:-1]):
        outer = common.store(_descend(manifest, nodes, outer), "merkle-paths")
    return _descend(manifest, groups[0], outer, finish=True)
