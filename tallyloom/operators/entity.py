"""Item-name matching, clustering and stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators.scale import cut_lineage, discard, spread

MIN_SCORE, STRONG_SCORE, STRONG_MARGIN, RECENT_MONTHS = 0.45, 0.6, 0.15, 2
TEXT, PRICED, HANDED = 0.75, 0.15, 0.1  # shares of words, equal price and hand-over in a score


def _month_no(m: Column) -> Column:
    return F.substring(m, 1, 4).cast("int") * 12 + F.substring(m, 6, 2).cast("int") - 1


def handover(old_months: Column, new_months: Column) -> Column:
    """The old name stopped at most two months before the new one started."""
    gap = _month_no(F.array_min(new_months)) - _month_no(F.array_max(F.filter(
        old_months, lambda m: m < F.array_min(new_months))))
    return F.coalesce((F.size(F.array_intersect(old_months, new_months)) == 0) & gap.between(1, RECENT_MONTHS), F.lit(False))


def _found(word: Column, words: Column, joined: Column) -> Column:
    """A word is found as itself, as two joined words, or as a prefix (4+ letters)."""
    near = F.exists(words, lambda w: ((F.length(word) >= 4) & w.startswith(word)) | ((F.length(w) >= 4) & word.startswith(w)))
    return F.array_contains(words, word) | F.array_contains(joined, word) | near


def _covered(src: Column, other: Column, joined: Column) -> Column:
    """Share of the source words' weight found in the other name."""
    total = F.aggregate(src, F.lit(0.0), lambda s, x: s + x["weight"])
    hit = F.aggregate(src, F.lit(0.0), lambda s, x: s + F.when(_found(x["word"], other, joined), x["weight"]).otherwise(0.0))
    return F.when(total > 0, hit / total).otherwise(0.0)


def _stem(word: Column) -> Column:
    return F.substring(word, 1, 4)


ANYONE = "*"  # the pool of names without a supplier


def worded_names(new: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both lists with their words, the words' weights, and the rare words through which a name looks for partners.

    ``keep`` is for partners at another price, ``keep_priced`` for those at the same one.
    """
    n_docs = new.select("name").unionByName(old.select("name")).agg(F.count("*")).scalar()

    def worded(df, side):
        return df.select(F.col("name").alias(side), "supplier", F.col("price").alias(side + "_price"), F.col("months").alias(side + "_months"),
                         T.name_tokens(F.col("name")).alias("words"))

    def joined(words):
        return F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
                          lambda x, y: F.concat(x, y))

    wn, wo = worded(new, "new"), worded(old, "old")
    every = wn.select(F.explode(F.array_distinct("words")).alias("word")).unionByName(wo.select(F.explode(F.array_distinct("words")).alias("word")))
    weights = every.groupBy("word").agg((F.log((n_docs + 1) / (F.count("*") + 1)) + 1.0).alias("weight"))

    def weighed(df, side):
        flat = df.select(side, F.posexplode("words").alias("i", "word")).join(weights, "word")
        g = flat.groupBy(side).agg(F.sort_array(F.collect_list(F.struct("i", "word", "weight"))).alias("w"))
        g = g.withColumn("total", F.aggregate("w", F.lit(0.0), lambda s, x: s + x["weight"]))

        # words from the most frequent on, with the weight gathered so far
        def rare(need):
            run = F.aggregate(F.array_sort("w", lambda x, y: F.when(x["weight"] < y["weight"], -1).when(x["weight"] > y["weight"], 1).otherwise(x["i"] - y["i"])),
                              F.struct(F.lit(0.0).alias("t"), F.array().cast("array<string>").alias("keep")),
                              lambda s, x: F.struct((s["t"] + x["weight"]).alias("t"), F.when(
                                  s["t"] + x["weight"] >= need * F.col("total") - 1e-9, F.concat(s["keep"], F.array(x["word"]))).otherwise(s["keep"]).alias("keep")))
            return run["keep"]

        g = g.withColumns({"keep": rare((MIN_SCORE - HANDED) / TEXT), "keep_priced": rare((MIN_SCORE - HANDED - PRICED) / TEXT)})
        return df.join(g.drop("total"), side).withColumn("joined", joined(F.col("words")))

    return cut_lineage(weighed(wn, "new"), "new"), cut_lineage(weighed(wo, "old"), "old")


def candidates(wn: DataFrame, wo: DataFrame) -> DataFrame:
    """Distinct (new, old) pairs that can reach the minimum score.

    A pair below the needed word coverage on both sides can't be suggested, so a name only looks for partners through its
    rarer words: the most frequent ones are left out as long as they could not reach that coverage together. What is needed depends on the
    price, whose bonus is known when two names meet, so names at one price meet by their price too. Matching words start with
    the same four letters, so pairs meet by equality on that stem. No candidate is lost, and frequent words create no pairs.
    """
    def stems(df, side, column):
        source = F.col(column) if column else F.concat("words", "joined")
        cents = F.floor(F.col(side + "_price") * 100 + 0.5)
        # an old name stands in its supplier's pool and in that of the names without one
        pool = F.array_compact(F.array(F.col("supplier"), F.lit(ANYONE))) if side == "old" else F.array(F.coalesce("supplier", F.lit(ANYONE)))
        return df.select(side, cents.alias("cents"), F.explode(pool).alias("pool"), F.array_distinct(F.transform(source, _stem)).alias("s")).select(side, "cents", "pool", F.explode("s").alias("stem"))

    met = []
    for column, priced in (("keep", False), ("keep_priced", True)):
        for left, right in ((column, None), (None, column)):
            a, b, on = stems(wn, "new", left), stems(wo, "old", right), ["pool", "stem"]
            if priced:  # prices that differ by less than half a cent may be rounded apart
                a, on = a.withColumn("cents", F.explode(F.array(F.col("cents") - 1, F.col("cents"), F.col("cents") + 1))), [*on, "cents"]
            met.append(a.join(b, on).select("new", "old"))
    every = met[0]
    for m in met[1:]:
        every = every.unionByName(m)
    return every.filter("new <> old").distinct()


def pair_scores(new: DataFrame, old: DataFrame) -> DataFrame:
    """Scores of the (new, old) pairs of one supplier that reach the minimum; a new name without supplier is compared with all old ones.

    ``new`` / ``old``: name, supplier, price, months.
    """
    wn, wo = worded_names(new, old)
    n = wn.select("new", "supplier", "new_price", "new_months", F.col("w").alias("nw"), F.col("words").alias("nt"), F.col("joined").alias("nj"))
    o = wo.select("old", "old_price", "old_months", F.col("w").alias("ow"), F.col("words").alias("ot"), F.col("joined").alias("oj"))
    s = spread(candidates(wn, wo).join(n, "new").join(o, "old"), "new", "old")
    text = TEXT * (0.7 * _covered(F.col("ow"), F.col("nt"), F.col("nj")) + 0.3 * _covered(F.col("nw"), F.col("ot"), F.col("oj")))
    same = F.coalesce(F.abs(F.col("new_price") - F.col("old_price")) < 0.005, F.lit(False))
    hand = handover(F.col("old_months"), F.col("new_months"))
    score = text + F.when(same, PRICED).otherwise(0.0) + F.when(hand, HANDED).otherwise(0.0)
    return s.select("supplier", "new", "old", score.alias("score"), same.cast("int").alias("same_price"), hand.cast("int").alias("handover"),
                    F.coalesce(F.arrays_overlap("old_months", "new_months"), F.lit(False)).cast("int").alias("together"), "new_price", "old_price").filter(F.col("score") >= MIN_SCORE)


def one_to_one(scores: DataFrame) -> DataFrame:
    """Greedy best-first matching as rounds of mutual best pairs.

    A pair that is the best of both its names is what the greedy order takes
    first among them, so taking all mutual bests and repeating gives the same
    matching. Names are unique, so ties are broken by (new, old). Every round
    takes at least the best pair of all, so the loop ends by itself.
    """
    left = cut_lineage(scores.filter(F.col("score") >= MIN_SCORE).select("supplier", "new", "old", "score"), "pairs")
    out = None
    while True:
        key = F.struct("score", "new", "old")
        bn = left.groupBy("new").agg(F.max(key).alias("b")).select("new", F.col("b.old").alias("old"))
        bo = left.groupBy("old").agg(F.max(key).alias("b")).select("old", F.col("b.new").alias("new"))
        taken = cut_lineage(bn.join(bo, ["new", "old"]).join(left, ["new", "old"]).select("supplier", "new", "old", "score"), "taken")
        if taken.isEmpty():
            discard(left)
            return out if out is not None else taken
        out = taken if out is None else out.unionByName(taken)
        rest = cut_lineage(left.join(taken.select("new"), "new", "left_anti").join(taken.select("old"), "old", "left_anti"), "pairs")
        discard(left)
        left = rest


def _short(x: Column) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(x.cast("decimal(18,4)").cast("string"), "0+$", ""), r"\.$", "")


def suggest(new: DataFrame, old: DataFrame) -> DataFrame:
    """One row for each new name: the suggested old name, strong or weak, or none, and why.

    A strong suggestion has a supplier, a clear score, a clean hand-over and no conflict of prices, on the sheet or in
    the names; an unknown price is no conflict. Clear means ahead of every other pair that either name could still form:
    names that are paired with somebody else don't count. Pairs below the minimum score are no rivals.
    """
    scores = cut_lineage(pair_scores(new, old), "scores")
    match = cut_lineage(one_to_one(scores), "matches")
    open_old = scores.join(match.select("old"), "old", "left_anti").groupBy("new").agg(F.max("score").alias("second_new"))
    open_new = scores.join(match.select("new"), "new", "left_anti").groupBy("old").agg(F.max("score").alias("second_old"))
    j = match.drop("score").join(scores.drop("supplier"), ["new", "old"]).join(open_old, "new", "left").join(open_new, "old", "left")
    clear = F.col("score") - F.greatest(F.coalesce("second_new", F.lit(0.0)), F.coalesce("second_old", F.lit(0.0))) >= STRONG_MARGIN
    differs = F.coalesce(F.abs(F.col("new_price") - F.col("old_price")) >= 0.005, F.lit(False))
    np, op = T.price_suffix(F.col("new")), T.price_suffix(F.col("old"))
    suffixes = F.coalesce(np != op, F.lit(False))
    known = F.col("supplier").isNotNull()
    strong = known & (F.col("score") >= STRONG_SCORE) & clear & (F.col("handover") == 1) & ~differs & ~suffixes
    why = F.concat_ws("; ", F.when(known, "same supplier").otherwise("supplier unknown"),
                      F.when(differs, F.concat(F.lit("price differs ("), _short(F.col("old_price")), F.lit(" -> "), _short(F.col("new_price")), F.lit(")")))
                      .when(F.col("new_price").isNotNull() & F.col("old_price").isNotNull(), "same price"),
                      F.when(suffixes, F.concat(F.lit("different price in the name (@"), _short(op), F.lit(" -> @"), _short(np), F.lit(")"))),
                      F.when(F.col("handover") == 1, "old name stopped when this one started").when(F.col("together") == 1, "old name still on the sheet").otherwise("no clean hand-over"),
                      F.when(~clear, "another item is almost as close"))
    picked = j.select("supplier", "new", "old", F.round("score", 3).alias("score"), F.when(strong, "strong").otherwise("weak").alias("strength"), why.alias("why"))
    # a name that lost its best partner still shows it, and to whom it went
    lost = scores.join(match.select("new"), "new", "left_anti").groupBy("supplier", "new").agg(F.max(F.struct("score", "old")).alias("b"))
    rival = match.select(F.col("old").alias("o"), F.col("new").alias("rival"))
    rest = lost.join(rival, F.col("b.old") == F.col("o"), "left").select(
        "supplier", "new", F.col("b.old").alias("old"), F.round("b.score", 3).alias("score"), F.lit("weak").alias("strength"),
        F.concat(F.lit("'"), F.coalesce("rival", F.lit("another name")), F.lit("' matches '"), F.col("b.old"), F.lit("' better")).alias("why"))
    alone = new.select("supplier", F.col("name").alias("new")).join(scores.select("new").distinct(), "new", "left_anti").select(
        "supplier", "new", F.lit(None).cast("string").alias("old"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("strength"),
        F.when(F.col("supplier").isNotNull(), "no similar item from the same supplier").otherwise("no similar item").alias("why"))
    return picked.unionByName(rest).unionByName(alone)


def min_label_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Connected components: every node takes the smallest label it can reach.

    Each round also jumps a label to its own label, so long chains settle in a
    logarithmic number of rounds. ``edges``: a, b; ``nodes``: node.
    """
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut_lineage(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("l2"))
        jump = step.join(step.select(F.col("node").alias("l2"), F.col("l2").alias("l3")), "l2", "left").select(
            "node", "label", F.least("l2", F.coalesce("l3", "l2")).alias("new_label"))
        jump = cut_lineage(jump, "labels")
        changed = not jump.filter(F.col("label") != F.col("new_label")).isEmpty()
        labels = jump.select("node", F.col("new_label").alias("label"))
        if not changed:
            return labels


def similar_pairs(names: DataFrame, col: str, min_ratio: int) -> DataFrame:
    """All pairs whose edit distance is at most (1 - ratio) of the longer one.

    Two strings within ``d`` edits share one of any ``d + 1`` pieces of the
    shorter one, at nearly the same place. The shorter side offers its pieces,
    the longer side its substrings around each place, and pairs meet by
    equality. Exact: no pair within the distance is missed.
    """
    far = 1 - min_ratio / 100.0

    def pieces(df, short, long):
        tau = F.floor(F.col("ll") * far + 1e-9).cast("int")
        df = df.withColumn("tau", tau).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("tau"))))
        k = F.col("tau") + 1
        base = F.floor(F.col("sl") / k).cast("int")
        plain = k - F.col("sl") % k  # the first pieces have the base length
        start = F.col("i") * base + F.greatest(F.col("i") - plain, F.lit(0))
        return df.withColumn("at", start.cast("int")).withColumn("len", (base + (F.col("i") >= plain).cast("int")).cast("int")).filter("len > 0")

    n = F.length(col)
    lo, hi = F.ceil(n * (1 - far) - 1e-9).cast("int"), F.floor(n / (1 - far) + 1e-9).cast("int")
    short = pieces(names.select(F.col(col).alias("a"), n.alias("sl"), F.explode(F.sequence(n, hi)).alias("ll")), "a", "b")
    short = short.select("a", "sl", "ll", "i", F.substring("a", F.col("at") + 1, F.col("len")).alias("piece"))
    long = pieces(names.select(F.col(col).alias("b"), n.alias("ll"), F.explode(F.sequence(F.greatest(lo, F.lit(1)), n)).alias("sl")), "a", "b")
    first, last = F.greatest(F.lit(0), F.col("at") - F.col("tau")), F.least(F.col("ll") - F.col("len"), F.col("at") + F.col("tau"))
    long = long.filter(first <= last).withColumn("s", F.explode(F.sequence(first, last)))
    long = long.select("b", "sl", "ll", "i", F.substring("b", F.col("s") + 1, F.col("len")).alias("piece")).distinct()
    met = short.join(long, ["sl", "ll", "i", "piece"]).filter("a <> b AND (sl < ll OR a < b)")
    close = F.levenshtein("a", "b") <= F.floor(F.col("ll") * far + 1e-9)
    return met.filter(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


PIVOTS = (1, 8)  # members of a group that all others meet
STRAYS = 64  # members of a shape that its names outside the largest component meet; up to so many of these meet all
FEW = (4, 16)  # members of two near classes that meet before the rest is asked for
DEALT = 4096  # members of a class that one task compares with all others
DELETED = 3  # digits that are left out at most to find near digits; beyond that all members meet
SAMPLED = 20_000_000  # rows of near digits that are looked through at once while links are likely


def _most_edits(far: float, a: str, b: str) -> Column:
    return F.floor(F.greatest(F.length(a), F.length(b)) * far + 1e-9).cast("int")


def _alike(far: float) -> Column:
    """The edit distance of ``a`` and ``b`` is at most the share ``far`` of the longer one."""
    return F.call_function("levenshtein", F.col("a"), F.col("b"), _most_edits(far, "a", "b")) >= 0


def _merged(named: DataFrame, found: DataFrame) -> DataFrame:
    """``named``, which has a column label, after the components a and b of ``found`` are joined."""
    found = cut_lineage(found.distinct(), "links")
    if found.head(1):
        ends = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
        roots = min_label_components(found, ends).select(F.col("node").alias("label"), F.col("label").alias("root"))
        named = cut_lineage(_renamed(named, roots), "labels")
    discard(found)
    return named


def _renamed(named: DataFrame, roots: DataFrame) -> DataFrame:
    """``named`` with its labels replaced as ``roots`` (label, root) says."""
    return named.join(roots, "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root").select(named.columns)


def _apart(met: DataFrame, far: float) -> DataFrame:
    """The components a and b of those pairs (a, label_a, b, label_b) that link two of them."""
    return met.filter((F.col("label_a") != F.col("label_b")) & _alike(far)).select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))


def _within(nodes: DataFrame, far: float) -> DataFrame:
    """``nodes`` (node, shape, cls) with a label that is the same for names of one shape that are linked through a few of its names.

    Every name is compared with those few once; which of them belong together is a small question then.
    """
    sizes = nodes.groupBy("shape").agg(F.count("*").alias("size")).filter("size > 1")
    draw = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / PIVOTS[-1])) == 0
    few = nodes.join(sizes, "shape").filter(draw).groupBy("shape").agg(F.sort_array(F.collect_list("node")).alias("few"))
    close = lambda p: F.call_function("levenshtein", F.col("node"), p, F.floor(F.greatest(F.length("node"), F.length(p)) * far + 1e-9).cast("int")) >= 0
    met = cut_lineage(nodes.join(few, "shape", "left").withColumn("hits", F.filter("few", close)).drop("few"), "met")
    first = F.get("hits", F.lit(0))
    same = cut_lineage(met.filter(F.size("hits") > 1).select(first.alias("a"), F.explode(F.slice("hits", 2, 1 << 20)).alias("b")).distinct(), "links")
    ends = same.select(F.col("a").alias("node")).union(same.select("b")).distinct()
    roots = min_label_components(same, ends).select(F.col("node").alias("label"), F.col("label").alias("root"))
    named = cut_lineage(_renamed(met.select(*nodes.columns, F.coalesce(first, "node").alias("label")), roots), "labels")
    discard(met, same)
    return named


def _without_strays(named: DataFrame, far: float) -> DataFrame:
    """``named`` (node, shape, label) joined by links of names outside the largest component of their shape: first with some
    members of the shape, then, where few such names are left, with all.

    One name that missed its links would else keep its whole class apart from all others.
    """
    for whole in (False, True):
        largest = (named.groupBy("shape", "label").agg(F.count("*").alias("c")).groupBy("shape")
                   .agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("size"), F.max("c").alias("most")).filter("most < size"))
        largest = cut_lineage(largest.filter(F.col("size") - F.col("most") <= STRAYS) if whole else largest, "largest")
        placed = named.join(largest, "shape")
        every = placed if whole else placed.filter(F.pmod(F.xxhash64("node", F.lit(STRAYS)), F.ceil(F.col("size") / STRAYS)) == 0)
        few = placed.filter("label <> main").select("shape", F.col("label").alias("label_a"), F.col("node").alias("a"))
        met = spread(few, "a").join(every.select("shape", F.col("label").alias("label_b"), F.col("node").alias("b")), "shape")
        named = _merged(named, _apart(met, far))
        discard(largest)
    return named


def _linked(groups: DataFrame, labels: DataFrame, far: float) -> DataFrame:
    """``labels`` (node, label) joined by links of the members of a group with a few of them; ``groups``: key, node.

    Only members of different components are compared. So a group whose members link costs a multiple of its length.
    """
    for pivots in PIVOTS:
        placed = cut_lineage(groups.join(labels, "node"), "placed")
        sizes = placed.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("l"), F.max("label").alias("m")).filter("l < m").select("key", "size")
        open_ = placed.join(sizes, "key")
        draw = F.pmod(F.xxhash64("node", F.lit(pivots)), F.ceil(F.col("size") / pivots)) == 0
        few = open_.filter(draw).select("key", F.col("label").alias("label_a"), F.col("node").alias("a"))
        met = spread(few, "key").join(spread(open_.select("key", F.col("label").alias("label_b"), F.col("node").alias("b")), "key"), "key")
        labels = _merged(labels, _apart(met, far))
        discard(placed)
    return labels


def _digit_edits():
    """Column function (u, v, most): by how many edits the digits of two names of these classes differ at most if the names are within ``most`` edits.

    In a class all digits are 0. Names within ``most`` edits have an alignment that costs c in their classes, where h
    digits are left out, put in or set against another character, and at most ``most - c`` digits are replaced. So their
    digits are within ``most - c + h`` edits, and the least c for each h is found by the usual recursion. -1 where no alignment is cheap enough.
    """
    def reach(u, v, most):
        import numpy as np
        import pandas as pd

        if not len(u):
            return pd.Series([], dtype="int32")
        lu, lv, most = u.str.len().to_numpy(), v.str.len().to_numpy(), most.to_numpy()

        def codes(texts, width):
            return np.array([[ord(c) for c in t] + [-1] * (width - len(t)) for t in texts], dtype=np.int32).reshape(len(texts), width)

        n, wu, wv, hs = len(u), int(lu.max()), int(lv.max()), int(most.max()) + 1
        a, b, zero, far = codes(u, wu), codes(v, wv), ord("0"), np.int16(10_000)

        def step(cost, disturbs):
            """One more edit, which disturbs a digit where ``disturbs``."""
            moved = np.full_like(cost, far)
            moved[:, 1:] = cost[:, :-1]
            return np.where(disturbs[:, None], moved, cost) + np.int16(1)

        start = np.full((n, hs), far, dtype=np.int16)
        start[:, 0] = 0
        row = [start]
        for j in range(wv):
            row.append(step(row[-1], b[:, j] == zero))
        out = np.full((n, hs), far, dtype=np.int16)
        for i in range(wu + 1):
            if i:
                digit = a[:, i - 1] == zero
                new = [step(row[0], digit)]
                for j in range(wv):
                    same, other = a[:, i - 1] == b[:, j], digit != (b[:, j] == zero)
                    best = np.where(same[:, None], row[j], step(row[j], other))
                    best = np.minimum(best, step(row[j + 1], digit))
                    new.append(np.minimum(best, step(new[-1], b[:, j] == zero)))
                row = new
            for k in np.flatnonzero(lu == i):
                out[k] = row[lv[k]][k]
        edits = most[:, None] - out + np.arange(hs)[None, :]
        return pd.Series(np.where(out <= most[:, None], edits, -1).max(axis=1).astype("int32"))

    return F.pandas_udf(reach, "int")


def _left_out(digits: Column, most: Column, limit: int) -> Column:
    """array<struct(variant, out)>: ``digits`` and what remains of them if up to ``most`` (at most ``limit``) are left out.

    Strings within ``most`` edits have one in common.
    """
    texts = F.array(digits)
    found = [F.transform(texts, lambda t: F.struct(t.alias("variant"), F.lit(0).alias("out")))]
    for k in range(1, limit + 1):
        texts = F.array_distinct(F.flatten(F.transform(texts, lambda t: F.when(F.length(t) > 0, F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))).otherwise(F.array().cast("array<string>")))))
        found.append(F.when(most >= k, F.transform(texts, lambda t: F.struct(t.alias("variant"), F.lit(k).alias("out")))).otherwise(F.array().cast("array<struct<variant:string,out:int>>")))
    return F.concat(*found)


def _by_digits(named: DataFrame, open_: DataFrame, far: float, every: int = 1) -> DataFrame:
    """``named`` joined by links of names whose digits are within ``e`` edits; ``open_``: classes u and v, e.

    Names meet by what remains of their digits. ``every`` takes only one in so many of these remainders; only such are followed
    that occur in more than one component.
    """
    limit = open_.agg(F.max("e")).first()[0]
    if limit is None:
        return named
    most = open_.select(F.col("u").alias("cls"), "e").union(open_.select("v", "e")).groupBy("cls").agg(F.max("e").alias("most"))
    rows = named.join(most, "cls").withColumn("x", F.explode(_left_out(F.regexp_replace("node", "[^0-9]", ""), F.col("most"), limit)))
    rows = rows.select("node", "cls", "label", "x.variant", "x.out").filter(F.pmod(F.xxhash64("variant"), F.lit(every)) == 0)
    written = rows = cut_lineage(rows, "digits")
    shared = rows.groupBy("variant").agg(F.min("label").alias("l"), F.max("label").alias("m")).filter("l < m").select("variant")
    rows = rows.join(shared, "variant", "left_semi")
    sides = [rows.join(open_.select(F.col(c).alias("cls"), "u", "v", "e"), "cls").filter("out <= e").select("u", "v", "variant", F.col("node").alias(n), F.col("label").alias("label_" + n))
             for c, n in (("u", "a"), ("v", "b"))]
    named = _merged(named, _apart(sides[0].join(sides[1], ["u", "v", "variant"]), far))
    discard(written)
    return named


def _across(named: DataFrame, pairs: DataFrame, far: float) -> DataFrame:
    """``named`` (node, cls, label) joined by all links of names of near classes; ``pairs``: classes u and v, their sizes c_u and c_v.

    Pairs of classes that are one component are never looked at. A few members meet first. What is left is decided by the digits in which the names of a
    pair may differ: names meet by equal or near digits, or, where classes are small or their digits may differ in much, all with all.
    """
    def still_open(pairs, named):
        one = named.groupBy("cls").agg(F.min("label").alias("l"), F.max("label").alias("m"))
        one = cut_lineage(one.select("cls", F.when(F.col("l") == F.col("m"), F.col("l")).alias("only")), "class-labels")
        u, v = (one.select(F.col("cls").alias(c), F.col("only").alias("only_" + c)) for c in "uv")
        left = pairs.join(u, "u").join(v, "v").filter("NOT coalesce(only_u = only_v, false)").drop("only_u", "only_v")
        left = cut_lineage(left, "open")
        discard(one)
        return left

    def side(pairs, members, cls, name):
        return pairs.join(members.select(F.col("cls").alias(cls), F.col("node").alias(name), F.col("label").alias("label_" + name)), cls)

    sizes = cut_lineage(named.groupBy("cls").agg(F.count("*").alias("size")), "sizes")
    left = still_open(pairs, named)
    for few in FEW:
        drawn = named.join(sizes, "cls").filter(F.pmod(F.xxhash64("node", F.lit(few)), F.ceil(F.col("size") / few)) == 0)
        drawn = cut_lineage(drawn, "drawn")
        met = spread(side(left.select("u", "v"), drawn, "u", "a"), "u", "v").join(spread(side(left.select("u", "v"), drawn, "v", "b"), "u", "v"), ["u", "v"])
        named = _merged(named, _apart(met, far))
        # of classes this small, all members have met
        left = still_open(left.filter((F.col("c_u") > few) | (F.col("c_v") > few)), named)
    left = left.withColumn("e", _digit_edits()("u", "v", _most_edits(far, "u", "v")))
    left = cut_lineage(left.filter("e >= 0"), "open")
    digits = F.length(F.regexp_replace("u", "[^0]", "")), F.length(F.regexp_replace("v", "[^0]", ""))
    # links are likely where digits may differ: some remainders are enough for most pairs
    near = F.when(F.col("e") > 0, F.col("c_u") * (digits[0] + 1) + F.col("c_v") * (digits[1] + 1))
    every = int(left.agg(F.coalesce(F.sum(near), F.lit(0))).first()[0]) // SAMPLED + 1
    while every > 1:
        named = _by_digits(named, left.filter("e > 0").select("u", "v", F.lit(1).alias("e")), far, every)
        left = still_open(left, named)
        every //= 16

    def remainders(size, n):  # of up to e digits out of n
        each, total = F.lit(1.0), F.lit(1.0)
        for k in range(1, DELETED + 1):
            each = each * (n - (k - 1)) / k
            total = total + F.when(F.col("e") >= k, F.greatest(each, F.lit(0.0))).otherwise(0.0)
        return size * total

    whole = (F.col("e") > DELETED) | (F.col("e") >= F.least(*digits)) & (F.col("e") > 0) | (F.col("c_u") * F.col("c_v") <= 16 * (remainders(F.col("c_u"), digits[0]) + remainders(F.col("c_v"), digits[1])))
    left = cut_lineage(left.withColumn("whole", whole).withColumn("deals", F.ceil(F.col("c_u") / DEALT).cast("int")), "open")
    named = _by_digits(named, left.filter("NOT whole").select("u", "v", "e"), far)
    a = side(left.filter("whole").select("u", "v", "deals"), named, "u", "a").withColumn("deal", F.pmod(F.hash("a"), "deals")).drop("deals")
    b = side(left.filter("whole").select("u", "v", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal")), named, "v", "b")
    return _merged(named, _apart(spread(a, "u", "v", "deal").join(spread(b, "u", "v", "deal"), ["u", "v", "deal"]), far))


def _shape_lists(shapes: DataFrame, far: float) -> tuple[DataFrame, DataFrame]:
    """Lists (t, sl, i, piece) through which shapes within ``t`` edits meet, as the shorter and as the longer one.

    A pair of names is linked within ``t`` edits at most, where t is the lesser ``most`` of their shapes. One of the two offers its own most
    and the other any t from ``least`` on, so each side offers all of them. Pieces as in ``similar_pairs``; an empty piece is found everywhere.
    Of t + 1 pieces, the first one at which no more edits than pieces lie behind is whole, with at most i edits before it and t - i after it.
    """
    s = shapes.withColumn("t", F.explode(F.sequence("least", "most"))).withColumn("n", F.length("shape"))

    def pieces(df):
        df = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("t"))))
        base, plain = F.floor(F.col("sl") / (F.col("t") + 1)).cast("int"), F.col("t") + 1 - F.col("sl") % (F.col("t") + 1)
        return df.withColumns({"at": F.col("i") * base + F.greatest(F.col("i") - plain, F.lit(0)), "len": base + (F.col("i") >= plain).cast("int")})

    short = pieces(s.withColumn("sl", F.col("n"))).select("t", "sl", "i", F.expr("substring(shape, at + 1, len)").alias("piece"), "shape")
    long = pieces(s.withColumn("sl", F.explode(F.sequence(F.greatest(F.col("n") - F.col("t"), F.lit(0)), F.col("n")))))
    before, after, longer = F.col("i"), F.col("t") - F.col("i"), F.col("n") - F.col("sl")
    first = F.greatest(F.lit(0), F.col("at") - before, F.col("at") + longer - after)
    last = F.least(F.col("n") - F.col("len"), F.col("at") + before, F.col("at") + longer + after)
    long = long.filter(first <= last).withColumn("p", F.explode(F.sequence(first, last)))
    return short, long.select("t", "sl", "i", F.expr("substring(shape, p + 1, len)").alias("piece"), "shape").distinct()


def similar_components(names: DataFrame, col: str, min_ratio: int) -> DataFrame:
    """(node, label): components of the distinct ``names`` under the links of ``similar_pairs``, each labelled by its least name.

    No pairs are kept. Names that are equal without their digits have one shape; taking characters of one kind out of
    two strings never adds edits, so names can be linked only if their shapes are as near. Names of one class are equal but for the values of
    their digits, and their classes are as near, too. Links are sought with a few members of each shape, then
    along lists of shapes with a common piece, then between all near classes that are not in one component already. What links is
    skipped; near classes that don't link are told apart by the digits in which their names may differ.
    """
    far = 1 - min_ratio / 100.0
    nodes = cut_lineage(names.select(F.col(col).alias("node"), F.regexp_replace(col, "[0-9]+", "").alias("shape"), F.regexp_replace(col, "[0-9]", "0").alias("cls")).distinct(), "nodes")
    named = _without_strays(_within(nodes, far), far)
    n = F.length("node")
    sized = nodes.groupBy("shape").agg(F.min("node").alias("node"), F.floor(F.min(n) * far + 1e-9).cast("int").alias("least"), F.floor(F.max(n) / (1 - far) * far + 1e-9).cast("int").alias("most"))
    sized = cut_lineage(sized, "shapes")
    short, long = [cut_lineage(x, "shape-lists") for x in _shape_lists(sized, far)]
    lists = short.union(long).distinct().join(sized.select("shape", "node"), "shape")
    # one name stands for each shape here
    own = cut_lineage(named.join(sized.select("node"), "node").select("node", "label"), "labels")
    roots = _linked(lists.select(F.struct("t", "sl", "i", "piece").alias("key"), "node"), own, far).withColumnRenamed("label", "root")
    named = cut_lineage(_renamed(named, own.join(roots, "node").select("label", "root").distinct()), "labels")

    one = named.groupBy("shape").agg(F.min("label").alias("l"), F.max("label").alias("m"))
    one = cut_lineage(one.select("shape", F.when(F.col("l") == F.col("m"), F.col("l")).alias("only")), "shape-labels")
    a, b = short.join(one, "shape"), long.join(one.select("shape", F.col("only").alias("only_b")), "shape").withColumnRenamed("shape", "shape_b")
    met = a.join(b, ["t", "sl", "i", "piece"]).filter("shape <> shape_b AND NOT coalesce(only = only_b, false)")
    near = met.select("t", F.least("shape", "shape_b").alias("x"), F.greatest("shape", "shape_b").alias("y")).distinct().filter("levenshtein(x, y, t) >= 0").select("x", "y").distinct()
    near = near.union(one.filter("only IS NULL").select("shape", "shape"))
    classes = nodes.groupBy("shape", "cls").agg(F.count("*").alias("c"))
    u, v = (classes.select(F.col("shape").alias(x), F.col("cls").alias(c), F.col("c").alias("c_" + c)) for x, c in (("x", "u"), ("y", "v")))
    pairs = near.join(u, "x").join(v, "y").filter("x <> y OR u <= v")
    pairs = pairs.filter(F.call_function("levenshtein", F.col("u"), F.col("v"), _most_edits(far, "u", "v")) >= 0).select("u", "v", "c_u", "c_v")
    pairs = cut_lineage(pairs, "near-classes")
    named = _across(named.select("node", "cls", "label"), pairs, far)
    least = named.groupBy("label").agg(F.min("node").alias("root"))
    labels = cut_lineage(_renamed(named, least).select("node", "label"), "labels")
    discard(nodes, sized, short, long, one, pairs)
    return labels


def name_clusters(names: DataFrame, min_ratio: int = 80, medium: int = 90) -> DataFrame:
    """One row for each name: its cluster, the suggested spelling, how sure that is and whether a person should look.

    ``names``: name, rows. Names that differ in case and blanks only are one spelling. Spellings whose sorted words are alike to
    ``min_ratio`` per cent are joined into clusters, each named by its least sorted spelling. A cluster of one spelling is sure. In a
    cluster whose spellings differ in colour, size, product code or numbers, every spelling stays on its own and is to be looked at;
    comparing each kind of mark as a set tells that without forming pairs. Else all take the most frequent name, with a confidence
    that follows from the weakest link. Names without a word are left out.
    """
    key = T.spelling_key(F.col("name"))
    n = names.withColumn("key", key).filter("key <> ''").withColumn("norm", F.array_join(F.array_sort(F.split("key", " ")), " "))
    n = cut_lineage(n, "spellings")
    labels = similar_components(n, "norm", min_ratio)
    best = F.max_by("name", F.struct("rows", "name"))
    spelled = n.groupBy("norm", "key").agg(best.alias("own"), F.max("rows").alias("top")).withColumn("m", T.product_marks(F.col("key")))
    spelled = spelled.join(labels, spelled["norm"] == labels["node"]).drop("node", "norm")
    differ = [F.countDistinct(F.col("m")[c]) > 1 for c in ("colours", "sizes", "code", "numbers")]
    whole = spelled.groupBy("label").agg(F.count("*").alias("spellings"), F.max_by("own", F.struct("top", "own")).alias("all"), (differ[0] | differ[1] | differ[2] | differ[3]).alias("conflict"))
    whole = cut_lineage(whole, "clusters")
    # only clusters that take one name need their weakest link
    agreed = whole.filter("spellings > 1 AND NOT conflict").select("label").join(labels, "label")
    edges = similar_pairs(agreed, "node", min_ratio)
    score = 100 * (1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b")))
    weakest = edges.withColumn("score", score).join(labels, edges["a"] == labels["node"]).groupBy("label").agg(F.min("score").alias("weakest"))
    whole = whole.join(weakest, "label", "left").withColumn("weakest", F.coalesce("weakest", F.lit(100.0)))
    alone = F.col("spellings") == 1
    j = n.join(spelled.select("key", "own", "label"), "key").join(whole, "label")
    clean = F.regexp_replace(F.trim(F.when(alone | F.col("conflict"), F.col("own")).otherwise(F.col("all"))), r"\s+", " ")
    sure = F.when(alone | F.col("conflict"), "high").when(F.col("weakest") >= medium, "medium").otherwise("low")
    return j.select("name", F.col("label").alias("cluster"), "rows", clean.alias("suggested"), sure.alias("confidence"), (~alone).cast("int").alias("needs_review"), (~alone & F.col("conflict")).cast("int").alias("conflict"))


def stable_ids(names: DataFrame, old_ids: DataFrame) -> DataFrame:
    """Known names keep their id; new ones get the next ids in name order."""
    from tallyloom.operators.scale import ranked_running

    j = names.join(old_ids, "item_name", "left")
    top = old_ids.agg(F.coalesce(F.max("product_id"), F.lit(0))).scalar()
    fresh = j.filter("product_id IS NULL").select("item_name", F.lit(1).alias("one"))
    # order by a prefix number first so the ranking runs in blocks
    code = sum((F.coalesce(F.ascii(F.substring("item_name", i, 1)), F.lit(0)) * 256 ** (4 - i) for i in range(1, 5)), F.lit(0)).cast("long")
    ranked = ranked_running(fresh.withColumn("key", -code), "key", ["item_name"], None, "one")
    new = ranked.select("item_name", (top + F.col("rank_no")).alias("product_id"), F.lit(1).alias("is_new"))
    return j.filter("product_id IS NOT NULL").select("item_name", "product_id", F.lit(0).alias("is_new")).unionByName(new)
