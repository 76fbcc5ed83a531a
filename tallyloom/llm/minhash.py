"""MinHash near-duplicates by an inverted join over signature coordinates.

A text is the set of its word shingles. Texts with equal sets form one class;
everything below is about classes, so copies cost nothing.

1. A signature has K minima. A class is posted under each (coordinate, value).
   Pairs at the similarity bound agree in fewer than T coordinates with a
   probability below ``miss``, which fixes T.
2. *Prefix*: with all elements in one order, rarest first, two signatures that
   agree in T coordinates share one among their K - T + 1 rarest. Only those
   are posted. Values held by one class need no posting, and a class with fewer
   than T shared values has no partner and is skipped.
3. *Skip*: in a posting list, first all members meet one pivot, the least
   class. Links join members into components, and from then on only members of
   different components meet: first a few pivots drawn from the list with all
   members outside its largest component, then more, then those still outside with
   all others. As far as members link, a list costs a multiple of its length; no
   link between components is left out.
4. Pairs must have similar set sizes (lists are dealt by size band), few
   differing bits in a sketch, and T agreeing coordinates, before they are
   confirmed on the full sets. The sketch of a small set holds, for each of 512
   buckets of shingle hashes, whether their number is odd: two sets differ in at
   least as many shingles as their sketches in bits, so this bound loses nothing
   and is nearly tight. A large set would fill the buckets; its sketch holds
   four bits of each coordinate of the signature. Sets near the limit have both.

Words are runs of non-blank ASCII characters, lower-cased in A-Z. A text with
fewer words than a shingle is one shingle; an empty or null text has none and
is linked with nothing. Shingles and sets are held as 64-bit hashes. Rows with
the same id and different texts are separate; a null id never names a
component that has another id. Texts of any length are read whole. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.arrow_text import mix, raw, shingles, words
from tallyloom.llm.components import components
from tallyloom.operators.scale import cut_lineage, discard

BITS = 64  # coordinates in the sketch of a large set
PLANES = 4  # bits of each
WORDS = 8  # 64-bit words of a sketch
BUCKETS = 64 * WORDS  # bits in the sketch of a small set
PIVOTS = (8, 64)  # drawn from each list in the rounds between the first and the last
SIEVE = 1 << 24  # bits in the map of the ids whose texts are read again
U64 = np.uint64


def collisions_needed(coordinates: int, similarity: float, miss: float) -> int:
    """Largest T for which fewer than T agreeing coordinates have a probability below ``miss``."""
    tail = 0.0
    for t in range(coordinates + 1):
        tail += comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if tail >= miss:
            return max(1, t)
    return coordinates


def differences_allowed(coordinates: int, similarity: float, miss: float) -> int:
    """Number of differing sketch bits that pairs at the bound exceed with a probability below ``miss``.

    A coordinate that differs, differs in each of its ``PLANES`` bits with a probability of one half.
    """
    q = 1 - similarity
    chance = [0.0] * (PLANES * coordinates + 1)
    for m in range(coordinates + 1):
        weight = comb(coordinates, m) * q**m * (1 - q) ** (coordinates - m) / 2.0 ** (PLANES * m)
        for d in range(PLANES * m + 1):
            chance[d] += weight * comb(PLANES * m, d)
    tail = 0.0
    for d in range(len(chance) - 1, 0, -1):
        tail += chance[d]
        if tail >= miss:
            return d
    return 0


def multipliers(coordinates: int) -> np.ndarray:
    return mix(np.arange(1, coordinates + 1, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Per slice: sorted distinct shingles of all rows, the start of each row's run, number of rows."""
    body, at = raw(column)
    for lo, hi, h, row, _ in words(body, at):
        n = hi - lo
        s, r = shingles(h, row, k)
        count = np.bincount(row, minlength=n)
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            begin = np.cumsum(count) - count
            whole = []
            for i in short.tolist():
                x = U64(0)
                for w in h[begin[i]:begin[i] + count[i]]:
                    x = x * U64(0xC2B2AE3D27D4EB4F) + w
                whole.append(x)
            s, r = np.concatenate([s, mix(np.array(whole, U64))]), np.concatenate([r, short])
        order = np.argsort(r, kind="stable") if len(short) else slice(None)
        s, r = s[order], r[order]
        begin = np.searchsorted(r, np.arange(n + 1))
        parts = [np.unique(s[i:j]) for i, j in zip(begin[:-1].tolist(), begin[1:].tolist())]
        yield np.concatenate(parts) if parts else s, np.cumsum([0, *map(len, parts)]), n


def odd_buckets(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per run of distinct shingles, as ``WORDS`` words: in which of ``BUCKETS`` buckets their number is odd."""
    n = len(at) - 1
    bucket = (mix(values) >> U64(40)).astype(np.int64) % BUCKETS
    odd = np.bincount(np.repeat(np.arange(n), np.diff(at)) * BUCKETS + bucket, minlength=n * BUCKETS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def odd_limit(percent: int) -> int:
    """Largest set whose sketch of odd buckets is used: pairs at the bound differ in about a quarter as many shingles as there are buckets."""
    return max(1, BUCKETS * (100 + percent) // (8 * max(1, 100 - percent)))


def _class_of(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signed(text, k: int, coordinates: int):
    """Class, set size, signature and sketch of odd buckets of a text column."""
    with np.errstate(over="ignore"):
        factors = multipliers(coordinates)

    @F.arrow_udf("n int, class long, signature array<int>, odd array<long>")
    def sign(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with np.errstate(over="ignore"):
            for column in columns:
                sizes, names, minima, odd = [], [], [], []
                for values, at, n in shingle_sets(column, k):
                    size = np.diff(at)
                    own = np.zeros((n, len(factors)), np.uint32)
                    some = np.flatnonzero(size)
                    if len(some):
                        for j, f in enumerate(factors):
                            own[some, j] = np.minimum.reduceat(values * f, at[some]) >> U64(32)
                    sizes.append(size)
                    minima.append(own)
                    odd.append(odd_buckets(values, at))
                    names += [_class_of(values[i:j]) if j > i else None for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
                flat = np.concatenate(minima).view(np.int32).ravel() if minima else np.zeros(0, np.int32)
                places = np.arange(len(size) + 1, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(places * len(factors)), pa.array(flat))
                sketches = pa.ListArray.from_arrays(pa.array(places * WORDS), pa.array(np.concatenate(odd) if odd else np.zeros(0, np.int64)))
                yield pa.StructArray.from_arrays([pa.array(size.astype(np.int32)), pa.array(names, pa.int64()), lists, sketches], ["n", "class", "signature", "odd"])
    return sign(text)


def _whole_sets(text, k: int):
    """Class and sorted shingles of a text column."""
    @F.arrow_udf("class long, shingles array<long>")
    def gather(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with np.errstate(over="ignore"):
            for column in columns:
                names, flat, sizes = [], [], [0]
                for values, at, _ in shingle_sets(column, k):
                    flat.append(values)
                    sizes += np.diff(at).tolist()
                    names += [_class_of(values[i:j]) if j > i else None for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                values = np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(values))
                yield pa.StructArray.from_arrays([pa.array(names, pa.int64()), lists], ["class", "shingles"])
    return gather(text)


def _plane(signature: Column, bit: int) -> Column:
    """One bit of each coordinate."""
    return F.aggregate(signature, F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1) + F.shiftright(x, bit).cast("long").bitwiseAND(1))


def _band(n: str, percent: int) -> Column:
    """Sets that differ by more than one band in size are not similar enough."""
    return F.floor(F.log(F.col(n).cast("double")) / -np.log(percent / 100)).cast("int")


def _sketched(classes: DataFrame, percent: int) -> DataFrame:
    """class, n, band, sketch and, where a neighbouring band compares the other kind of sketch, that one as ``spare``."""
    words = lambda columns: F.struct(*[c.alias(f"p{i}") for i, c in enumerate(columns)])
    odd = words([F.col("odd")[i] for i in range(WORDS)])
    planes = words([_plane(F.slice("signature", 1, BITS), i) for i in range(PLANES)] + [F.lit(0).cast("long")] * (WORDS - PLANES))
    last = _last_odd(percent)
    sized = classes.withColumn("band", _band("n", percent))
    return sized.select("class", "n", "band", F.when(F.col("band") <= last, odd).otherwise(planes).alias("sketch"),
                        F.when(F.col("band") == last, planes).when(F.col("band") == last + 1, odd).alias("spare"))


def _last_odd(percent: int) -> int:
    """Last band whose members are compared by odd buckets."""
    return int(np.log(odd_limit(percent)) / -np.log(percent / 100))


def _pairs(left: DataFrame, right: DataFrame, percent: int, differences: int) -> DataFrame:
    """Distinct pairs of different classes and components that meet in a list and may be similar enough.

    Both have the columns key, class, component, n, band, sketch and spare. The band of the right side decides which sketches are compared.
    """
    last = _last_odd(percent)
    near = left.withColumn("meets", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)))
    near = near.select("key", "class", "component", "n", "meets", F.when((F.col("meets") <= last) == (F.col("band") <= last), F.col("sketch")).otherwise(F.col("spare")).alias("sketch"))
    other = right.select("key", F.col("band").alias("meets"), F.col("class").alias("other"), F.col("component").alias("apart"), F.col("n").alias("m"), F.col("sketch").alias("sketch2"))
    differ = sum((F.bit_count(F.col("sketch")[f"p{i}"].bitwiseXOR(F.col("sketch2")[f"p{i}"])) for i in range(WORDS)), F.lit(0))
    few = F.when(other["meets"] <= last, differ * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent)).otherwise(differ <= differences)
    met = near.join(other, (near["key"] == other["key"]) & (near["meets"] == other["meets"]) & (F.col("class") != F.col("other")) & (F.col("component") != F.col("apart"))
                    & (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & few)
    return met.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()


def _confirmed(pairs: DataFrame, signatures: DataFrame, sets: DataFrame, collisions: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs that agree in enough coordinates, as a written table, and those of them whose sets are similar enough."""
    side = lambda df, c, v: df.select(F.col("class").alias(c), F.col(v).alias(f"{v}_{c}"))
    agree = F.aggregate(F.zip_with("signature_a", "signature_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    close = pairs.join(side(signatures, "a", "signature"), "a").join(side(signatures, "b", "signature"), "b").filter(agree >= collisions).select("a", "b")
    close = cut_lineage(close, "close-pairs")
    full = close.join(side(sets, "a", "shingles"), "a").join(side(sets, "b", "shingles"), "b")
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return close, full.select("a", "b", both.alias("both"), (F.size("shingles_a") + F.size("shingles_b")).alias("n")).filter(F.col("both") * 100 >= (F.col("n") - F.col("both")) * percent).select("a", "b")


def _sifted(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted`` (column ``key``); none that is in it is lost.

    A bitmap of ``SIEVE`` hashed keys, 2 MB at most whatever the table, goes to all tasks, so that texts nobody needs aren't moved by the join that follows.
    """
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(SIEVE))
    slot, at = F.shiftright(place, 15), place.bitwiseAND(32767)
    bits = wanted.select(slot.alias("__slot"), at.alias("__at")).repartition("__slot").groupBy("__slot").agg(F.bitmap_construct_agg("__at").alias("__bits"))
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__at div 8 + 1 as int), 1)")), 16, 10).cast("int")
    met = rows.withColumns({"__slot": slot, "__at": at}).join(F.broadcast(bits), "__slot")
    return met.filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(__at % 8 as int))")) != 0).select(*rows.columns)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, coordinates: int = 64, miss: float = 1e-9, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the id names its component) for each row.

    Two texts are linked if 100 * intersection >= ``percent`` * union of their
    sets of ``k``-word shingles.
    """
    needed = collisions_needed(coordinates, percent / 100, miss)
    differences = differences_allowed(min(BITS, coordinates), percent / 100, miss)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = cut_lineage(base.select("doc_id", _signed(F.col("text"), k, coordinates).alias("s")).select("doc_id", "s.*"), "signatures")
    classes = cut_lineage(rows.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("label"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("odd").alias("odd")), "classes")

    elements = classes.select("class", F.posexplode("signature")).select("class", (F.shiftleft(F.col("pos").cast("long"), 32) + F.col("col")).alias("key"))
    common = elements.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1")
    prefix = (elements.join(common, "key").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("held", "key"))).alias("e"))
              .filter(F.size("e") >= needed).select("class", F.explode(F.slice("e", F.lit(1), F.size("e") - (needed - 1))).alias("e")).select(F.col("e.key").alias("key"), "class"))
    prefixes = cut_lineage(prefix, "prefixes")
    met = prefixes.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    postings = cut_lineage(prefixes.join(met, "key").join(_sketched(classes, percent), "class"), "postings")

    discard(prefixes)

    # full sets of the classes that meet another one
    active = cut_lineage(classes.join(postings.select("class").distinct(), "class", "left_semi").select("class", "label", "signature"), "active")
    texts = _sifted(base, "doc_id", active.select(F.col("label").alias("doc_id")))
    held = texts.join(active.select(F.col("label").alias("l"), F.col("class").alias("c")), F.col("doc_id").eqNullSafe(F.col("l")))
    held = held.select("c", _whole_sets(F.col("text"), k).alias("s")).filter("s.class = c").select("s.class", "s.shingles")
    sets = cut_lineage(held.dropDuplicates(["class"]), "shingle-sets")

    roots = None
    for turn, pivots in (("least", 1), *(("drawn", n) for n in PIVOTS), ("all", 0)):
        if roots is None:
            placed = postings.withColumn("component", F.col("class"))
            left = postings.groupBy("key").agg(F.min(F.struct("class", "n", "band", "sketch", "spare")).alias("p")).select("key", "p.*").withColumn("component", F.col("class"))
            right = placed
        else:
            placed = cut_lineage(postings.join(roots.withColumnRenamed("node", "class"), "class", "left").select(*postings.columns, F.coalesce("root", "class").alias("component")), "placed")
            largest = (placed.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key")
                       .agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("size"), F.max("c").alias("most")).filter("most < size"))
            open_ = placed.join(largest, "key")
            left = open_.filter("component <> main").select(*placed.columns)
            right = open_.select(*placed.columns)
            if turn == "drawn":
                right = open_.filter(F.pmod(F.xxhash64("class", F.lit(pivots)), F.ceil(F.col("size") / pivots)) == 0).select(*placed.columns)
        close, full = _confirmed(_pairs(left, right, percent, differences), active, sets, needed, percent)
        found = cut_lineage(full, "links")
        discard(close, *([placed] if roots is not None else []))
        if roots is None or found.head(1):
            roots = components(found if roots is None else found.union(roots))  # each node's link to its root stands for all earlier links

    discard(postings, active, sets)
    named = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").select("class", "label", F.coalesce("root", "class").alias("root"))
    names = named.groupBy("root").agg(F.min("label").alias("component_id"))
    of_class = named.join(names, "root").select("class", "component_id")
    out = rows.select("doc_id", "n", "class").join(of_class, "class", "left").withColumn("component_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
