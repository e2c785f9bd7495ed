"""Merkle manifest of a dataset, with one inclusion proof per row by octopus multiproofs.

Leaves hash the rows. Each ``tree`` value has a tree over its leaves in ``order``, runs of eight nodes hash into one; the subroots of all
trees hash into the root in the same way. A leaf partition (a run of leaves, or any other set of them) does not ask for each leaf's proof: it computes the
smallest set of node coordinates that its leaves miss on their ways to the root, fetches these once from the node table, derives the
interiors its leaves share, and expands the single proofs from them. Nodes are built bottom up in blocks of several levels.

Defined cases: nulls are hashed as such; rows with a null ``tree`` form a tree of their own, which comes first, as do rows with null ``order`` inside
a tree. Rows that tie in ``order`` stand by their leaves; repeated rows are leaves of their own. Other columns are not read. A table of
one row is its own root, with an empty proof. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rainrisk.llm.common import ascii_lower, stored
from rainrisk.operators.scale import attach, numbered

#: Nodes in a run; levels that one task builds above its block; leaves in a partition.
FAN, LEVELS, PART = 8, 4, 4096
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Number that stands for the tree over the subroots.
TOP = -1


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_hash(columns: tuple[str, ...] = COLUMNS, instead: dict[str, Column] | None = None) -> Column:
    """Hash of the named columns of a row, ``instead`` of some of them other values."""
    values = [(instead or {}).get(c, F.col(c)).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def sizes(n: int) -> list[int]:
    """Nodes of a tree of ``n`` leaves by level."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out


def missing(have: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Fewest coordinates (level, index) that, with the leaves ``have`` (ascending), give all their ways to the top of ``n`` leaves."""
    out = []
    for level, size in enumerate(sizes(n)[:-1]):
        up = np.unique(have // FAN)
        runs = (up[:, None] * FAN + np.arange(FAN)).ravel()
        out += [(level, i) for i in np.setdiff1d(runs[runs < size], have).tolist()]
        have = up
    return out


class Paths:
    """Ways to the top of one tree from the leaves ``known`` (index to digest) and the ``fetched`` nodes (coordinate to digest)."""

    def __init__(self, known: dict[int, str], fetched: dict[tuple[int, int], str], n: int):
        self.sizes, self.levels, have = sizes(n), [], known
        for level, size in enumerate(self.sizes):
            if level:
                have = {i: digest([self.levels[-1][j] for j in range(i * FAN, min(self.sizes[level - 1], (i + 1) * FAN))]) for i in {i // FAN for i in have}}
            self.levels.append(have | {i: h for (at, i), h in fetched.items() if at == level and size > 1})
        self.top = self.levels[-1][0]
        self._above: dict[tuple[int, int], str] = {}

    def around(self, level: int, i: int) -> tuple[list[str], list[str]]:
        """The nodes of the run before and after node ``i``."""
        start, end, nodes = i // FAN * FAN, min(self.sizes[level], (i // FAN + 1) * FAN), self.levels[level]
        return [nodes[j] for j in range(start, i)], [nodes[j] for j in range(i + 1, end)]

    def siblings(self, i: int, level: int = 0) -> str:
        """Digests of the siblings on the way from a node to the top; interiors keep theirs for all leaves below."""
        if level == len(self.sizes) - 1:
            return ""
        if (level, i) not in self._above:
            before, after = self.around(level, i)
            own = "".join(before + after) + self.siblings(i // FAN, level + 1)
            if not level:
                return own
            self._above[level, i] = own
        return self._above[level, i]

    def folded(self, i: int, node: str) -> str:
        """The top that another digest at leaf ``i`` would give."""
        for level in range(len(self.sizes) - 1):
            before, after = self.around(level, i)
            node, i = digest([*before, node, *after]), i // FAN
        return node


def nodes_of(leaves: DataFrame, most: int) -> DataFrame:
    """All nodes (tree, level, idx, hash, n, top) over ``leaves`` (tree, idx, hash, n leaves of the tree; at most ``most``)."""
    schema = "tree int, level int, idx long, hash string, n long, top boolean"

    def blocks(part: pa.Table) -> pa.Table:
        p = part.sort_by("idx").to_pydict()
        tree, n, base = p["tree"][0], p["n"][0], p["level"][0]
        have, rows, all_sizes = dict(zip(p["idx"], p["hash"])), [], sizes(n)
        for level in range(base + 1, min(base + LEVELS, len(all_sizes) - 1) + 1):
            runs: dict[int, list[str]] = {}
            for i, h in have.items():
                runs.setdefault(i // FAN, []).append(h)
            have = {i: digest(hs) for i, hs in runs.items()}
            rows += [(tree, level, i, h, n, all_sizes[level] == 1) for i, h in have.items()]
        kinds = pa.schema([("tree", pa.int32()), ("level", pa.int32()), ("idx", pa.int64()), ("hash", pa.string()), ("n", pa.int64()), ("top", pa.bool_())])
        return pa.table(list(zip(*rows)) or [[]] * 6, schema=kinds)

    lowest = leaves.select("tree", F.lit(0).alias("level"), "idx", "hash", "n", (F.col("n") == 1).alias("top"))
    out, base = lowest, lowest
    for level in range(0, len(sizes(most)) - 1, LEVELS):
        todo = base.where(f"level = {level} AND NOT top").withColumn("block", F.expr(f"idx div {FAN ** LEVELS}"))
        base = stored(todo.groupBy("tree", "block").applyInArrow(lambda t: blocks(t), schema))
        out = out.union(base)
    return out


def requests(leaves: DataFrame) -> DataFrame:
    """Coordinates (of, level, idx) that each leaf partition (tree, part) has to fetch, with the tops that its proofs end at."""
    schema = "tree int, part long, of int, level int, idx long"

    def wanted(p: pa.Table) -> pa.Table:
        tree, part, n, trees = (p.column(c)[0].as_py() for c in ("tree", "part", "n", "trees"))
        rows = [(tree, part, tree, level, i) for level, i in [*missing(np.unique(p.column("idx").to_numpy()), n), (len(sizes(n)) - 1, 0)]]
        rows += [(tree, part, TOP, level, i) for level, i in [*missing(np.array([tree]), trees), (len(sizes(trees)) - 1, 0)]]
        kinds = pa.schema([("tree", pa.int32()), ("part", pa.int64()), ("of", pa.int32()), ("level", pa.int32()), ("idx", pa.int64())])
        return pa.table([list(c) for c in zip(*rows)], schema=kinds)

    return leaves.select("tree", "part", "idx", "n", "trees").groupBy("tree", "part").applyInArrow(wanted, schema)


def expanded(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """Proof of every leaf (tree, part, idx, n, trees, key, leaf, claimed); ``nodes`` are all nodes (tree, level, idx, hash)."""
    at = nodes.select(F.col("tree").alias("of"), "level", "idx", "hash")
    fetched = requests(leaves).join(at, ["of", "level", "idx"]).select("tree", "part", "of", "level", "idx", "hash")
    kind = leaves.schema["key"].dataType.simpleString()
    schema = f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, tree int, idx long"

    def expand(own: pa.Table, got: pa.Table) -> pa.Table:
        p, g = own.to_pydict(), got.to_pydict()
        tree, n, trees = p["tree"][0], p["n"][0], p["trees"][0]
        low, high = ({(v, i): h for o, v, i, h in zip(g["of"], g["level"], g["idx"], g["hash"]) if o == which} for which in (tree, TOP))
        subroot, root = low.pop((len(sizes(n)) - 1, 0)), high.pop((len(sizes(trees)) - 1, 0))
        inner = Paths(dict(zip(p["idx"], p["leaf"])), low, n)
        outer = Paths({tree: inner.top}, high, trees)
        above, folded, proofs = outer.siblings(tree), [], []
        for i, claimed in zip(p["idx"], p["claimed"]):
            proofs.append(hashlib.sha256((inner.siblings(i) + above).encode()).hexdigest())
            folded.append(outer.top if claimed is None else outer.folded(tree, inner.folded(i, claimed)))
        count = len(proofs)
        return pa.table([own.column("key"), own.column("leaf"), [subroot] * count, [root] * count, proofs, folded, [f == root for f in folded], own.column("tree"), own.column("idx")],
                        names=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "tree", "idx"])

    return leaves.groupBy("tree", "part").cogroup(fetched.groupBy("tree", "part")).applyInArrow(expand, schema)


def proven(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, tree: str = "lang", order: str = "doc_id", claimed: Column | None = None, part: int = PART) -> DataFrame:
    """One row per row of ``docs``: ``order``, leaf, subroot, root, proof_sha256, folded_root, verified, tree, idx.

    ``claimed`` is the leaf hash that somebody presents for the row, folded with the siblings of the manifest; null where it is the leaf itself.
    """
    claim = F.lit(None).cast("string") if claimed is None else claimed
    # a prefix keeps the null tree apart from all names and first
    name = F.coalesce(F.concat(F.lit("1"), F.col(tree).cast("string")), F.lit("0"))
    leaves = stored(docs.select(name.alias("name"), F.col(order).alias("key"), leaf_hash(columns).alias("leaf"), claim.alias("claimed"))
                    .withColumn("claimed", F.when(F.col("claimed") != F.col("leaf"), F.col("claimed"))))
    counts = leaves.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    trees = stored(numbered(counts, [], ["name"], "rn", total="trees").select("name", "n", (F.col("rn") - 1).cast("int").alias("tree"), "trees"))
    ranks = numbered(leaves, ["name"], ["key", "leaf"])
    placed = stored(attach(ranks, trees, ["name"], "inner").select("tree", (F.col("rn") - 1).alias("idx"), "n", "trees", "key", "leaf", "claimed")
                    .withColumn("part", F.expr(f"idx div {part}")))
    most = trees.agg(F.max("n").alias("n"), F.max("trees").alias("trees")).first()
    inner = nodes_of(placed.select("tree", "idx", F.col("leaf").alias("hash"), "n"), most["n"] or 1)
    tops = stored(inner.where("top").select("tree", "hash"))
    # the subroots are the leaves of one more tree
    subroots = tops.join(trees, "tree").select(F.lit(TOP).alias("tree"), F.col("tree").cast("long").alias("idx"), "hash", F.col("trees").alias("n"))
    nodes = inner.union(nodes_of(subroots, most["trees"] or 1))
    return expanded(placed, nodes).withColumnRenamed("key", order)


def tampered(rule: Column, columns: tuple[str, ...] = COLUMNS, text: str = "text") -> Column:
    """Leaf of the row with A-Z of ``text`` in lower case where ``rule`` holds, null elsewhere."""
    return F.when(rule, leaf_hash(columns, {text: ascii_lower(F.col(text))}))
