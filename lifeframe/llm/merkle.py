"""A Merkle manifest of a dataset: leaf digests, one root per group, one root of all, and a checked proof for each row.

A row's leaf is the SHA-256 of its fields, each as its UTF-8 byte count, ``:`` and its value, or ``-`` for null. The leaves of a
group stand in ascending order of id; of every ``FAN`` consecutive nodes the digests are concatenated as hex text and hashed,
level by level, until one node remains, the group's subroot. The subroots, ordered by group (null first), form the same kind of
tree, whose top is the root. A row's proof is the list of its siblings on the way up.

How it runs: a superblock is ``BLOCK`` consecutive nodes of a tree, so a group of any size is many superblocks.
Going up, each superblock is reduced to its top node, and the tops of one round are the nodes of the next (one
round makes a tree ``BLOCK`` times smaller). Going down, the nodes of a superblock are cogrouped with the one row of outer nodes that it
needs, the siblings above its top (Arrow tables, so that workers load no pandas); local reduction, the join of the local and the outer part of each proof, and the folding of
leaf and proof to a root all happen in that one call. A call sees at most ``BLOCK`` nodes and one outer row, whose length grows
with the logarithm of the table.

Defined cases: a null id is first in its group and never tampered with; null fields are ``-``, an empty text is ``0:``; rows that share an
id are ordered by their leaf, rows that agree in all fields are interchangeable; a lone leaf is its own subroot, a lone
subroot the root, and the digest of no siblings is that of the empty string; an empty table gives an empty
result. Extra columns are passed over.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeframe.llm.ordering import numbered
from lifeframe.session import discard, materialize

FAN = 8
DEPTH = 3  # levels of a superblock
BLOCK = FAN**DEPTH
_NODE = "tree long, pos long, n long, node string"
_OUTER = "tree long, pos long, before array<string>, after array<string>, subroot string, root string"
_RESULT = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A field as it enters a leaf."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*(field(f) for f in fields)), 256)


def levels_of(n: int) -> int:
    """Levels by which ``n`` nodes become one, or a superblock becomes its top."""
    levels = 0
    while n > 1 and levels < DEPTH:
        n, levels = -(-n // FAN), levels + 1
    return levels


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of all levels, lowest first."""
    out = [nodes]
    for _ in range(levels):
        out.append([digest("".join(out[-1][i : i + FAN])) for i in range(0, len(out[-1]), FAN)])
    return out


def siblings(level: list[str]) -> list[tuple[str, str]]:
    """Per node of a level the others of its run: those before it and those after it."""
    out = []
    for first in range(0, len(level), FAN):
        run = level[first : first + FAN]
        out += [("".join(run[:i]), "".join(run[i + 1 :])) for i in range(len(run))]
    return out


def _arrow(ddl: str) -> pa.Schema:
    """The Arrow schema of a result; digests are short, so 32-bit offsets do."""
    kinds = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def _first(table: pa.Table, name: str):
    return table.column(name)[0].as_py()


def _top(nodes: pa.Table) -> pa.Table:
    nodes = _ordered(nodes)
    n = _first(nodes, "n")
    node = climb(nodes.column("node").to_pylist(), levels_of(n))[-1][0]
    return pa.table([[_first(nodes, "tree")], [_first(nodes, "pos") // BLOCK], [-(-n // BLOCK)], [node]], _arrow(_NODE))


def _around(nodes: pa.Table) -> list[list[tuple[str, str]]]:
    levels = climb(nodes.column("node").to_pylist(), levels_of(_first(nodes, "n")))
    return [siblings(level) for level in levels[:-1]]


def _inner(nodes: pa.Table, outer: pa.Table) -> pa.Table:
    """The outer rows of a superblock's nodes, which are tops of superblocks themselves."""
    nodes, above = _ordered(nodes), outer.slice(0, 1).to_pylist()[0]
    around = _around(nodes)
    paths = [[level[i // FAN**k] for k, level in enumerate(around)] for i in range(nodes.num_rows)]
    before, after = ([[side[at] for side in path] + above[name] for path in paths] for at, name in enumerate(("before", "after")))
    tops = [[above[name]] * nodes.num_rows for name in ("subroot", "root")]
    return pa.table([nodes.column("tree"), nodes.column("pos"), before, after, *tops], _arrow(_OUTER))


def _finish(leaves: pa.Table, outer: pa.Table) -> pa.Table:
    """Proofs and folded roots of a superblock's leaves."""
    leaves, above = _ordered(leaves), outer.slice(0, 1).to_pylist()[0]
    around = _around(leaves)
    outside = list(zip(above["before"], above["after"]))
    # What lies above the superblock is the same for all its leaves.
    outside_text = "".join(b + a for b, a in outside)
    texts = [[b + a for b, a in level] for level in around]
    known: dict[str, str] = {}

    def fold_outside(top: str) -> str:
        node = top
        for before, after in outside:
            node = digest(before + node + after)
        return node

    proofs, folded = [], []
    for i, (leaf, tampered) in enumerate(zip(leaves.column("node").to_pylist(), leaves.column("tampered").to_pylist())):
        proofs.append(digest("".join(level[i // FAN**k] for k, level in enumerate(texts)) + outside_text))
        node = leaf if tampered is None else tampered
        for k, level in enumerate(around):
            before, after = level[i // FAN**k]
            node = digest(before + node + after)
        if node not in known:
            known[node] = fold_outside(node)
        folded.append(known[node])
    tops = [[above[name]] * leaves.num_rows for name in ("subroot", "root")]
    return pa.table([leaves.column("id"), leaves.column("node"), *tops, proofs, folded], _arrow(_RESULT))


def _in_blocks(nodes: DataFrame):
    return nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).groupBy("tree", "block")


def _rise(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """The nodes of all rounds; of the last, each tree has one."""
    stack = [nodes]
    while True:
        nodes = materialize(_in_blocks(nodes.select("tree", "pos", "n", "node")).applyInArrow(_top, _NODE), "merkle-nodes")
        stack.append(nodes)
        largest = -(-largest // BLOCK)
        if largest <= 1:
            return stack


def _descend(stack: list[DataFrame], outer: DataFrame, last: int) -> DataFrame:
    """From the outer rows of the topmost nodes to those of the nodes of round ``last``."""
    for nodes in reversed(stack[last:-1]):
        above = outer.withColumn("block", F.col("pos")).groupBy("tree", "block")
        lower = materialize(_in_blocks(nodes.select("tree", "pos", "n", "node")).cogroup(above).applyInArrow(_inner, _OUTER), "merkle-outer")
        discard(outer)
        outer = lower
    return outer


def manifest(
    docs: DataFrame, id_col: str = "doc_id", group: str = "lang", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    tampered: dict[str, Column] | None = None, where: Column | None = None,
) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root) of every row.

    ``folded_root`` is folded from the row's proof and its leaf as it is read later: ``tampered`` gives values that replace
    columns then, in the rows where ``where`` holds.
    """
    values = [F.col(f) for f in fields]
    leaf = leaf_of(values)
    later = F.lit(None).cast("string")
    if tampered:
        changed = leaf_of([tampered.get(f, F.col(f)) for f in fields])
        later = F.when(F.coalesce(F.lit(True) if where is None else where, F.lit(False)), changed)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(group).cast("string").alias("_group"), leaf.alias("node"), later.alias("tampered"))
    id_type = rows.schema["_id"].dataType
    placed = numbered(rows, ["_group"], ["_id", "node"], "pos")
    placed = materialize(placed, "merkle-leaves")
    sizes = materialize(placed.groupBy("_group").agg(F.count(F.lit(1)).alias("n")), "merkle-groups")
    most = sizes.agg(F.max("n"), F.count(F.lit(1))).first()
    trees = materialize(numbered(sizes, [], ["_group"], "tree").withColumnsRenamed({"_group": "_of"}), "merkle-trees")
    leaves = placed.join(trees, F.col("_group").eqNullSafe(F.col("_of"))).select(
        "tree", "pos", "n", "node", "tampered", F.col("_id").cast("string").alias("id")
    )
    leaves = materialize(leaves, "merkle-placed")
    discard(placed)

    lower = _rise(leaves, most[0] or 0)
    subroots = lower[-1].selectExpr("0L as tree", "tree as pos", f"{most[1]}L as n", "node")
    upper = _rise(subroots, most[1])
    tops = upper[-1].selectExpr("tree", "pos", "cast(array() as array<string>) as before", "cast(array() as array<string>) as after", "cast(null as string) as subroot", "node as root")
    over = _descend(upper, materialize(tops, "merkle-outer"), 0)
    # A subroot's place among the groups is its tree's number.
    own = lower[-1].select("tree", F.col("node").alias("_subroot"))
    over = over.drop("tree", "subroot").withColumnRenamed("pos", "tree").join(own, "tree").selectExpr("tree", "0L as pos", "before", "after", "_subroot as subroot", "root")
    outer = _descend(lower, materialize(over, "merkle-outer"), 1)
    above = outer.withColumn("block", F.col("pos")).groupBy("tree", "block")
    found = _in_blocks(leaves).cogroup(above).applyInArrow(_finish, _RESULT)
    return found.withColumn("id", F.col("id").cast(id_type)).withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered(value: Column) -> Column:
    """A-Z in lower case."""
    return F.translate(value, string.ascii_uppercase, string.ascii_lowercase)
