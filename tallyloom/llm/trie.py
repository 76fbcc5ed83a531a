"""Prefix trie of conversations, with subtree sums by centroid decomposition.

A node is a distinct sequence of first turns; conversations that start with it are its members. It is
named by its least member and its depth, and its parent edge leads to the node one turn shorter.

1. *Nodes.* Texts leave the scan as 128 bits of a digest. A prefix is known by its depth and the XOR of the digests of
   its turns, each mixed with its place, so it is a running sum that can be cut into blocks: a very long conversation
   is spread. Members are counted in slices of a group before the group is put together.
2. *Weights.* A node's weight is its number of members, so the weight of its subtree, members times turns still to
   come, is known when the nodes are.
3. *Centroids.* In a component, a connected piece of the parent-edge forest, the nodes whose subtree holds more than half of the
   weight are the path from the top to the centroid, the deepest of them. The total of the centroid's
   subtree within the component is added to that path; then the path loses the centroid's weight, and what hangs below each child of
   the centroid is a component of its own, as is the rest. No component has more than half of the weight of
   the one it came from, so the number of rounds is the logarithm of the number of turns, however deep the trie is.
4. Components of at most ``WHOLE`` turns are finished by one task each, many at a time and in the same way, in numpy.

Where a node hangs below a centroid is read off its least member's path: the node at the
centroid's depth plus one.

A null role or text is empty. Turns are in order of ``turn``, null first; turns with equal numbers are ordered by the SHA-256 of
role and text; repeated rows are repeated turns. Rows without conv_id belong to no conversation. An empty table has no nodes. Texts
may be of any length, as may conversations. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.mixing import WORD, spread_join
from tallyloom.operators.scale import cut_lineage, in_order

BLOCK = 1 << 14  # turns of one conversation in a block
SLICES = 64
WHOLE = 4096  # members times turns of a component that one task finishes
BATCH = 1 << 16  # nodes that one task holds, besides the component it reads
FAMILY = 20  # conversations that share their first turns


def attach(rows: DataFrame, groups: DataFrame, *keys: str) -> DataFrame:
    """Left join of rows with the one row of their group; a large group meets its row in ``SLICES`` places, a small one where it has rows."""
    sliced = rows.withColumn("__slice", F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys]), F.lit(SLICES)).cast("int"))
    there = sliced.select(*keys, "__slice").distinct().join(groups, list(keys))
    return sliced.join(there, [*keys, "__slice"], "left").drop("__slice")


def ordered_turns(rows: DataFrame) -> DataFrame:
    """conv, place i from 0, digest x and y, words, and the number of turns of the conversation; ``rows`` has conv_id, turn, role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = rows.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("sha"))
    said = said.select("conv", "turn", "words", *[F.conv(F.substring("sha", i, 15), 16, 10).cast("long").alias(n) for i, n in ((1, "x"), (16, "y"))])
    # repeated rows are one row until they have their places
    same = said.groupBy("conv", "turn", "x", "y").agg(F.first("words").alias("words"), F.count("*").alias("n"))
    placed = in_order(same, [F.asc_nulls_first("turn"), F.asc("x"), F.asc("y")], ["conv"], {"until": "n"})
    return placed.select("conv", F.explode(F.sequence(F.col("until") - F.col("n"), F.col("until") - 1)).alias("i"), "x", "y", "words", F.col("until_total").alias("turns"))


def _item(x: Column, y: Column, depth: Column) -> tuple[Column, Column]:
    """Digest of a turn at a depth, to be combined by XOR."""
    return F.xxhash64(x, y, depth), F.xxhash64(depth, y, x)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with turns of the first one of their family.

    Returns conversations (conv, length) and their prefixes (conv, depth, digest x and y, words of the last turn, length).
    """
    first = F.when(F.col("i") < 3, F.struct("i", "x", "y", "words"))
    whole = turns.groupBy("conv").agg(F.first("turns").alias("turns"), F.array_sort(F.collect_list(first)).alias("firsts"))
    base = whole.select(F.col("conv").alias("base"), F.col("firsts").alias("lent"))
    none = F.expr("cast(array() as array<struct<i: bigint, x: bigint, y: bigint, words: bigint>>)")
    convs = whole.withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % 4).cast("int")).withColumn("base", F.col("conv") - F.col("conv") % FAMILY).join(base, "base", "left")
    convs = convs.withColumn("lent", F.coalesce(F.slice("lent", F.lit(1), F.col("h")), none)).withColumn("length", F.size("lent") + F.greatest(F.col("turns") - F.col("h"), F.lit(0)))
    convs = cut_lineage(convs.select("conv", "turns", "h", "lent", "length"), "convs")

    def lent(n: Column, which: int) -> Column:
        return F.aggregate(F.slice("lent", F.lit(1), n), F.lit(0).cast("long"), lambda v, t: v.bitwiseXOR(_item(t["x"], t["y"], t["i"] + 1)[which]))

    taken = convs.select("conv", "length", "lent", F.posexplode("lent").alias("at", "t")).select(
        "conv", (F.col("at") + 1).cast("long").alias("depth"), lent(F.col("at") + 1, 0).alias("x"), lent(F.col("at") + 1, 1).alias("y"), "t.words", "length")
    blocks = convs.select("conv", "h", F.size("lent").alias("n_lent"), lent(F.size("lent"), 0).alias("x0"), lent(F.size("lent"), 1).alias("y0"), "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("turns") - 1) / BLOCK))).alias("block"))
    own = turns.withColumn("block", F.floor(F.col("i") / BLOCK)).join(blocks, ["conv", "block"]).filter("i >= h").withColumn("depth", F.col("i") - F.col("h") + F.col("n_lent") + 1)
    px, py = _item(F.col("x"), F.col("y"), F.col("depth"))
    own = own.withColumn("px", px).withColumn("py", py)
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("conv", "block").agg(F.bit_xor("px").alias("bx"), F.bit_xor("py").alias("by"))
    sums = sums.select("conv", "block", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(c) for c in ("bx", "by")])
    until = Window.partitionBy("conv", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("px", F.bit_xor("px").over(until)).withColumn("py", F.bit_xor("py").over(until)).join(sums, ["conv", "block"])
    x, y = (F.col(p).bitwiseXOR(F.col(b)).bitwiseXOR(F.col(z)) for p, b, z in (("px", "bx", "x0"), ("py", "by", "y0")))
    return convs.select("conv", "length"), cut_lineage(own.select("conv", "depth", x.alias("x"), y.alias("y"), "words", "length").union(taken), "prefixes")


def _centroids(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Subtree sums of whole components, sorted by component, many at a time."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part)
        if n < BATCH:
            continue
        rows = pd.concat(held, ignore_index=True)
        last = (rows.top == rows.top.iloc[-1]) & (rows.level == rows.level.iloc[-1])  # may go on
        yield _rolled(rows[~last])
        held, n = [rows[last]], int(last.sum())
    if held:
        yield _rolled(pd.concat(held, ignore_index=True))


def _rolled(rows: pd.DataFrame) -> pd.DataFrame:
    """Subtree sums of leaf and tokens in every component of ``rows``, by centroid decomposition of all at once."""
    rows = rows.reset_index(drop=True)
    place = pd.Series(np.arange(len(rows)), index=pd.MultiIndex.from_frame(rows[["node", "depth"]]))
    comp = rows.groupby(["top", "level"], sort=False).ngroup().to_numpy()
    above = pd.MultiIndex.from_arrays([rows.parent.fillna(0).astype("int64"), rows.depth - 1])
    up = np.where(rows.depth == rows.level, -1, place.reindex(above).fillna(-1).to_numpy()).astype(np.int64)  # the top has no parent here
    weight, own = rows.weight.to_numpy().copy(), rows[["leaf", "tokens"]].to_numpy().astype(np.int64)
    total = np.zeros(comp.max(initial=-1) + 1, np.int64)
    np.maximum.at(total, comp, weight)
    sums = np.zeros_like(own)
    live = np.argsort(rows.depth.to_numpy(), kind="stable")
    while len(live):
        c = comp[live]
        heavy = 2 * weight[live] > total[c]
        path = live[heavy]
        centre = np.full(len(total), -1)
        centre[comp[path]] = path  # the deepest comes last
        # each light node's highest light ancestor
        to = np.arange(len(rows))
        light = live[~heavy]
        is_light = np.zeros(len(rows) + 1, bool)
        is_light[light] = True
        to[light] = np.where(is_light[up[light]], up[light], light)
        while len(light):
            further = to[to[light]]
            if (further == to[light]).all():
                break
            to[light] = further
        root = to[light]
        below = up[root] == centre[comp[light]]
        down, root = light[below], root[below]
        found = np.zeros((len(total), 2), np.int64)
        np.add.at(found, comp[down], own[down])
        middle = centre[centre >= 0]
        found[comp[middle]] += own[middle]
        sums[path] += found[comp[path]]
        lost = np.zeros(len(total), np.int64)
        lost[comp[middle]] = weight[middle]
        weight[path] -= lost[comp[path]]
        total = total - lost
        if len(down):
            tops, number = np.unique(root, return_inverse=True)
            comp[down] = len(total) + number
            total = np.append(total, weight[tops])
            up[tops] = -1
        rest = np.ones(len(rows), bool)
        rest[middle] = False
        live = live[rest[live]]
    return pd.DataFrame({"node": rows.node, "depth": rows.depth, "n_leaves": sums[:, 0], "saved_tokens": sums[:, 1]})


ROLLED = "node long, depth long, n_leaves long, saved_tokens long"


def rollup(nodes: DataFrame, paths: DataFrame, root: int, total: int, whole: int = WHOLE) -> DataFrame:
    """Sums of ``leaf`` and ``tokens`` over the subtree of every node.

    ``nodes`` has node, depth, parent, weight (of the subtree), leaf and tokens; ``paths`` the node of each
    (conv, depth); ``total`` is the weight of the whole trie, whose top is ``root`` at depth 0.
    """
    state = nodes.select("node", "depth", "parent", "weight", "leaf", "tokens", F.lit(root).cast("long").alias("top"), F.lit(0).cast("long").alias("level"), F.lit(total).cast("long").alias("total"))
    comp = ["top", "level"]
    small, added = [], []
    if total > whole:
        state = cut_lineage(state, "trie")
    else:
        small, state = [state], None
    while state is not None:
        heavy = 2 * F.col("weight") > F.col("total")
        slices = state.filter(heavy).groupBy(*comp, F.pmod(F.xxhash64("node", "depth"), F.lit(SLICES)).alias("slice"))
        centres = cut_lineage(slices.agg(F.max(F.struct("depth", "node", "weight")).alias("c")).groupBy(*comp).agg(F.max("c").alias("c")), "centres")
        rows = attach(state, centres, *comp).withColumn("heavy", heavy).withColumn("block", F.floor(F.col("depth") / BLOCK))
        # where the paths of nodes deeper than the centroid pass its depth and the next one
        deep = ~F.col("heavy") & (F.col("depth") > F.col("c.depth"))
        asked = rows.filter(deep).groupBy("node", *comp, "block").agg(F.first("c").alias("c")).select("node", *comp, "block", "c", F.explode(F.array(F.col("c.depth"), F.col("c.depth") + 1)).alias("at"))
        low, high = centres.agg(F.min("c.depth"), F.max("c.depth")).first()
        passed = paths.filter(F.col("depth").between(low, high + 1)).select(F.col("conv").alias("node"), F.col("depth").alias("at"), F.col("node").alias("there"))
        asked = asked.join(passed, ["node", "at"], "left").withColumn("there", F.when(F.col("at") == 0, F.lit(root)).otherwise(F.col("there")))
        parted = asked.groupBy("node", *comp, "block").agg(F.max(F.when(F.col("at") == F.col("c.depth"), F.col("there") == F.col("c.node"))).alias("below"), F.max(F.when(F.col("at") > F.col("c.depth"), F.col("there"))).alias("child"))
        rows = rows.join(parted, ["node", *comp, "block"], "left").withColumn("below", F.coalesce("below", F.lit(False)) & deep).withColumn("centre", (F.col("node") == F.col("c.node")) & (F.col("depth") == F.col("c.depth")))
        rows = cut_lineage(rows.drop("block"), "parted")
        sums = rows.filter("below or centre").groupBy(*comp).agg(F.sum("leaf").alias("n_leaves"), F.sum("tokens").alias("saved_tokens"))
        added.append(attach(rows.filter("heavy").select("node", "depth", *comp), sums, *comp).select("node", "depth", "n_leaves", "saved_tokens"))
        down = rows.filter("below").select("node", "depth", "parent", "weight", "leaf", "tokens", F.col("child").alias("top"), (F.col("c.depth") + 1).alias("level"))
        tops = down.filter("node = top and depth = level").select(*comp, F.col("weight").alias("total"))
        up = rows.filter("not below and not centre").select(
            "node", "depth", "parent", F.when(F.col("heavy"), F.col("weight") - F.col("c.weight")).otherwise(F.col("weight")).alias("weight"), "leaf", "tokens", *comp, (F.col("total") - F.col("c.weight")).alias("total"))
        after = cut_lineage(attach(down, tops, *comp).select(*up.columns).union(up), "trie")
        small.append(after.filter(F.col("total") <= whole))
        state = after.filter(F.col("total") > whole)
        if state.isEmpty():
            state = None
    rest = small[0]
    for s in small[1:]:
        rest = rest.union(s)
    done = rest.repartition(*comp).sortWithinPartitions(*comp, "depth", "node").mapInPandas(_centroids, ROLLED)
    for a in added:
        done = done.union(a)
    return done.groupBy("node", "depth").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def _joined(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ids of each node, ascending, as pieces of text."""
    for part in parts:
        node, depth, conv = (part[c].to_numpy() for c in ("node", "depth", "conv"))
        cut = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (depth[1:] != depth[:-1]))) if len(part) else np.zeros(0, int)
        end = np.append(cut[1:], len(part))
        ids = list(map(str, conv.tolist()))
        yield pd.DataFrame({"node": node[cut], "depth": depth[cut], "first": conv[cut], "ids": [",".join(ids[i:j]) for i, j in zip(cut.tolist(), end.tolist())]})


def _hashed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's ids, whose pieces come in order."""
    now, state = None, None
    for part in parts:
        out = []
        for node, depth, ids in zip(part.node.tolist(), part.depth.tolist(), part.ids):
            if (node, depth) == now:
                state.update(b"," + ids.encode())
                continue
            if now is not None:
                out.append((*now, state.hexdigest()))
            now, state = (node, depth), hashlib.sha256(ids.encode())
        yield pd.DataFrame(out, columns=["node", "depth", "ends_sha256"])
    if now is not None:
        yield pd.DataFrame([(*now, state.hexdigest())], columns=["node", "depth", "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids ``conv`` of each (node, depth)."""
    keys = ["node", "depth"]
    pieces = rows.select(*keys, "conv").repartitionByRange(*keys, "conv").sortWithinPartitions(*keys, "conv").mapInPandas(_joined, "node long, depth long, first long, ids string")
    return pieces.repartition(*keys).sortWithinPartitions(*keys, "first").mapInPandas(_hashed, "node long, depth long, ends_sha256 string")


def prefix_trie(rows: DataFrame, whole: int = WHOLE) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations."""
    turns = cut_lineage(ordered_turns(rows), "turns")
    convs, prefixes = rebuilt(turns)
    top = convs.agg(F.min("conv").alias("node"), F.count("*").alias("n"), F.coalesce(F.sum(F.col("length") + 1), F.lit(0)).alias("weight"), F.count(F.when(F.col("length") == 0, 1)).alias("ends")).first()
    key = ["depth", "x", "y"]
    part = F.pmod(F.xxhash64("conv"), F.lit(SLICES)).cast("int")
    counts = prefixes.groupBy(*key, part.alias("slice")).agg(
        F.min("conv").alias("node"), F.count("*").alias("n"), F.first("words").alias("words"), F.count(F.when(F.col("depth") == F.col("length"), 1)).alias("ends"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight"))
    counts = cut_lineage(counts, "counts")
    nodes = counts.groupBy(*key).agg(F.min("node").alias("node"), F.sum("n").alias("n"), F.first("words").alias("words"), F.sum("ends").alias("ends"), F.sum("weight").alias("weight"))
    named = counts.select(*key, "slice").join(nodes.select(*key, "node"), key)
    paths = cut_lineage(prefixes.withColumn("slice", part).join(named, [*key, "slice"]).select("conv", "depth", "node", (F.col("depth") == F.col("length")).alias("ends")), "paths")

    parents = paths.select(F.col("conv").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    own = nodes.drop("x", "y").join(parents, ["node", "depth"], "left").withColumn("parent", F.when(F.col("depth") == 1, F.lit(top.node)).otherwise(F.col("parent")))
    if top.n:
        root = rows.sparkSession.range(1).select(F.lit(top.node).alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(top.n).alias("n"), F.lit(0).cast("long").alias("words"), F.lit(top.ends).alias("ends"), F.lit(top.weight).alias("weight"), F.lit(None).cast("long").alias("parent"))
        own = own.select(*root.columns).union(root)
    own = own.withColumn("leaf", (F.col("n") == F.col("ends")).cast("long")).withColumn("tokens", (F.col("n") - 1) * F.col("words"))
    own = cut_lineage(own, "nodes")
    sums = rollup(own, paths, top.node or 0, top.weight, whole)
    children = own.filter("depth > 0").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    last = ends(paths.filter("ends").select("node", "depth", "conv").union(convs.filter("length = 0").select(F.lit(top.node or 0).cast("long"), F.lit(0).cast("long"), "conv")))
    keys = ["node", "depth"]
    whole_row = own.join(sums, keys, "left").join(children, keys, "left").join(last, keys, "left")
    return whole_row.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
