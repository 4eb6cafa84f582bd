"""A prefix trie of conversations with totals of every subtree, by parallel tree contraction.

Every distinct sequence of first turns is a node. A node is named by its depth and by sums of hashes of (position, turn), which
are running sums along a conversation, taken in slices of ``SLICE`` turns; so a conversation of any length is no single group,
and a node's parent is named by subtracting the last turn. Names have 128 bits.

Subtree totals are found in rounds of joins. A round first rakes: nodes without live children leave the tree and add what they
hold to their parent, which is final for them. Then it compresses: of nodes with one live child, some that are no
neighbours of each other leave the tree; their child is hung under their parent, and what they hold is added to that
parent. Which ones go is told by a bit of their depth, one bit further each round since they had one child, which takes every
second node of a chain; where the depth has no more bits, by a hash. So a chain halves per round, and the number of
rounds grows with the logarithm of the nodes, whatever the depth. Afterwards the rounds are undone, last first: a compressed node's
total is what it held and its child's total. Every round is written to the shared folder; the tree shrinks geometrically, and so do the
joins of both passes.

The ids of the conversations that end in a node are joined and hashed in order: ids are sorted by range over all tasks,
each task makes pieces of ``PIECE`` ids, and a node's pieces are streamed through one hash state, as a sequential hash needs.

Defined cases: a null role or text is an empty one; turns with equal ``turn`` are ordered by the SHA-256 of role and text, and
repeated rows are turns of their own; rows without a conversation id belong to no conversation and are left out;
an empty table has no nodes. Extra columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifeframe.llm.ordering import numbered
from lifeframe.session import discard, materialize

SLICE = 1024  # turns whose hashes are summed at once, and copies of a turn that are written out at once
PIECE = 4096  # ids that are joined to one text before nodes are put together
LANES = 4  # sums of 32 bits in a node's name
_MASK = (1 << 32) - 1


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, turn_hash, bytes): every turn with its place in its conversation from 0, and the bytes of its text."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    hashed = F.unhex(F.sha2(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_), 256))
    slim = conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), hashed.alias("turn_hash"), F.octet_length(text_).cast("long").alias("bytes")
    )
    alike = slim.groupBy("conv", "turn", "turn_hash", "bytes").agg(F.count(F.lit(1)).alias("copies"))
    placed = materialize(numbered(alike, ["conv"], ["turn", "turn_hash"], "pos", weight="copies"), "trie-turns")
    columns = ["conv", "pos", "turn_hash", "bytes"]
    # Copies are written out in chunks, which tasks share.
    many = placed.filter("copies > 1").withColumn("chunk", F.expr(f"explode(sequence(0L, (copies - 1) div {SLICE}))")).repartition("conv", "pos", "chunk")
    each = many.withColumn("k", F.expr(f"explode(sequence(chunk * {SLICE}, least(copies, (chunk + 1) * {SLICE}) - 1))"))
    return placed.filter("copies = 1").select(*columns).unionByName(each.withColumn("pos", F.expr("pos + k")).select(*columns))


def rebuild(found: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the turns of another one: (conv, depth, turn_hash, bytes, last) and (conv, length) of all.

    Conversation c takes the first h turns of conversation c - c % ``group`` and goes on with its own turns after its first h, where h is
    the checksum of c modulo ``heads``.
    """
    sizes = found.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    convs = sizes.withColumns({"h": F.crc32(F.col("conv").cast("string")) % heads, "base": F.col("conv") - F.col("conv") % group})
    of_base = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    known = convs.join(of_base, "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = materialize(known.withColumn("length", F.expr("k + greatest(n - h, 0)")).select("conv", "h", "base", "k", "length"), "trie-plan")
    first = found.filter(f"pos < {heads - 1}").withColumnRenamed("conv", "base")
    begin = plan.join(first, "base").filter("pos < k").withColumn("depth", F.expr("pos + 1"))
    own = found.join(plan, "conv").filter("pos >= h").withColumn("depth", F.expr("k + pos - h + 1"))
    columns = ["conv", "depth", "turn_hash", "bytes", F.expr("depth = length").alias("last")]
    return begin.select(*columns).unionByName(own.select(*columns)), plan.select("conv", "length")


def _name(depth: Column | str, lanes: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, *(lane.bitwiseAND(F.lit(_MASK)) for lane in lanes))))


def root_name() -> Column:
    return _name(F.lit(0), [F.lit(0).cast("long")] * LANES)


def prefixes(rows: DataFrame) -> DataFrame:
    """(node, parent, conv, depth, bytes, last): the node that each turn of a conversation leads to."""
    wide = rows
    for half in range(LANES // 2):
        hashed = F.xxhash64(F.lit(half), "depth", "turn_hash")
        wide = wide.withColumns({f"l{2 * half}": hashed.bitwiseAND(F.lit(_MASK)), f"l{2 * half + 1}": F.shiftrightunsigned(hashed, 32)})
    lanes = [f"l{i}" for i in range(LANES)]
    sliced = materialize(wide.withColumn("slice", F.expr(f"(depth - 1) div {SLICE}")), "trie-rows")
    # Only conversations that are longer than a slice have anything before one.
    long = sliced.groupBy("conv", "slice").agg(*(F.sum(c).alias(c) for c in lanes)).withColumn("more", F.max("slice").over(Window.partitionBy("conv"))).filter("more > 0")
    ahead = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = long.select("conv", "slice", *(F.sum(c).over(ahead).alias(f"o{c}") for c in lanes)).filter("slice > 0")
    so_far = Window.partitionBy("conv", "slice").orderBy("depth")
    running = sliced.withColumns({f"s{c}": F.sum(c).over(so_far) for c in lanes}).join(offsets, ["conv", "slice"], "left")
    sums = [F.col(f"s{c}") + F.coalesce(f"o{c}", F.lit(0)) for c in lanes]
    before = [s - F.col(c) for s, c in zip(sums, lanes)]
    return running.select(_name("depth", sums).alias("node"), _name(F.col("depth") - 1, before).alias("parent"), "conv", "depth", "bytes", "last")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, first, ids) from rows sorted by node and id: ids joined, up to ``PIECE`` at a time."""
    node, held = None, []

    def piece():
        return pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "first": pa.array([held[0]], pa.int64()), "ids": [",".join(map(str, held))]})

    for batch in batches:
        out = {"node": [], "first": [], "ids": []}
        for name, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and (name != node or len(held) == PIECE):
                out["node"].append(node)
                out["first"].append(held[0])
                out["ids"].append(",".join(map(str, held)))
                held = []
            node = name
            held.append(conv)
        yield pa.RecordBatch.from_arrays([pa.array(out["node"], pa.binary()), pa.array(out["first"], pa.int64()), pa.array(out["ids"], pa.string())], ["node", "first", "ids"])
    if held:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends_sha256) from pieces sorted by node and first id."""
    node, state = None, None
    for batch in batches:
        names, found = [], []
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if name != node:
                if state:
                    names.append(node)
                    found.append(state.hexdigest())
                node, state = name, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(found, pa.string())], ["node", "ends_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["node", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the digest of the ids in ascending order, joined by commas, of each node's ``conv``."""
    ordered = ends.select("node", "conv").repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")
    pieces = ordered.mapInArrow(_pieces, "node binary, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node binary, ends_sha256 string")


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(node, *values): the sums of ``values`` over each node's subtree. ``nodes`` has (node, parent, depth, kids, *values); the root's parent is null."""
    plus = lambda other: {v: F.col(v) + F.coalesce(F.col(other + v), F.lit(0)) for v in values}
    sums = lambda name: [F.sum(v).alias(name + v) for v in values]
    state = materialize(nodes.select("node", "parent", "depth", "kids", F.when(F.col("kids") == 1, 0).alias("since"), *values), "trie-state")
    rounds: list[tuple[DataFrame, DataFrame | None]] = []
    while True:
        turn = len(rounds)
        leaves = state.filter("kids = 0 and parent is not null")
        up = leaves.groupBy(F.col("parent").alias("_to")).agg(F.count(F.lit(1)).alias("gone"), *sums("_"))
        live = state.filter("kids > 0 or parent is null").join(up, F.col("node") == F.col("_to"), "left")
        live = live.withColumns({"kids": F.expr("kids - coalesce(gone, 0)"), **plus("_")})
        live = live.withColumn("since", F.when(F.col("kids") == 1, F.coalesce("since", F.lit(turn))))
        live = materialize(live.select("node", "parent", "depth", "kids", "since", *values), "trie-live")
        raked = leaves.select("node", *values)
        if live.count() <= 1:
            rounds.append((raked, None))
            break
        bits = f"shiftright(depth, {turn} - since)"
        coin = F.expr(f"if({bits} > 0, {bits} & 1, xxhash64(node, {turn}) & 1) = 1")
        ready = live.filter("kids = 1 and parent is not null").filter(coin)
        chosen = ready.join(ready.select(F.col("node").alias("_above")), F.col("parent") == F.col("_above"), "left_anti")
        chosen = materialize(chosen.select(F.col("node").alias("through"), F.col("parent").alias("over"), *(F.col(v).alias(f"through_{v}") for v in values)), "trie-chosen")
        staying = live.join(chosen.select("through"), F.col("node") == F.col("through"), "left_anti")
        hung = staying.join(chosen, F.col("parent") == F.col("through"), "left").withColumn("parent", F.coalesce("over", "parent"))
        added = chosen.groupBy(F.col("over").alias("_to")).agg(*(F.sum(f"through_{v}").alias(f"_{v}") for v in values))
        after = hung.join(added, F.col("node") == F.col("_to"), "left").withColumns(plus("_"))
        after = materialize(after.select("node", "parent", "depth", "kids", "since", *values, "through", *(f"through_{v}" for v in values)), "trie-state")
        discard(chosen)
        rounds.append((raked, after.filter("through is not null")))
        state = after.select("node", "parent", "depth", "kids", "since", *values)

    known = live.select("node", *values)
    for raked, compressed in reversed(rounds):
        parts = known.unionByName(raked)
        if compressed is not None:
            below = compressed.select("through", F.col("node").alias("_child"), *(f"through_{v}" for v in values)).join(known, F.col("_child") == F.col("node"))
            parts = parts.unionByName(below.select(F.col("through").alias("node"), *((F.col(v) + F.col(f"through_{v}")).alias(v) for v in values)))
        known = materialize(parts, "trie-known")
    return known


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``rows`` (conv, depth from 1, turn_hash, bytes, last) and of all conversations ``convs`` (conv, length).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256); a conversation without turns is a
    member of the root only.
    """
    held = materialize(prefixes(rows), "trie-prefixes")
    inner = held.groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes")
    )
    root = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        root_name().alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes")
    )
    nodes = materialize(inner.withColumn("depth", F.col("depth").cast("long")).unionByName(root), "trie-nodes")
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("_of")).agg(F.count(F.lit(1)).alias("kids"))
    shaped = nodes.join(kids, F.col("node") == F.col("_of"), "left").withColumn("kids", F.coalesce("kids", F.lit(0))).drop("_of")
    shaped = materialize(shaped.selectExpr("*", "if(kids = 0, 1L, 0L) as n_leaves", "(n_convs - 1) * bytes as saved_tokens"), "trie-shaped")
    totals = subtree_totals(shaped, ["n_leaves", "saved_tokens"])
    ends = held.filter("last").select("node", "conv").unionByName(convs.filter("length = 0").select(root_name().alias("node"), "conv"))
    above = nodes.selectExpr("node as _above", "conv_id as parent_conv_id")
    found = shaped.drop("n_leaves", "saved_tokens").join(totals, "node").join(end_digests(ends), "node", "left").join(above, F.col("parent") == F.col("_above"), "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("kids").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
