"""Personal data: overlapping candidates, gradient-boosted trees, calibrated thresholds, redaction.

*Candidates.* For each kind (email, ip, card, phone) the base pattern and a
looser one propose spans, which may overlap. Base spans that pass their check
(octets, number of digits, Luhn) always stay. Base spans that fail it are counterexamples. A loose
candidate that is well formed and overlaps no checked base span is a proposal.

*Trees.* Boosted trees score the proposals from their context only (characters and key words on
both sides), as base spans have other formats than proposals. They are
fitted by Spark ML on the base spans of three quarters of the texts: checked ones
are the examples of personal data, failed ones that overlap none are the counterexamples. The
trees are then written as CASE expressions.

*Thresholds.* On the texts kept out of the fit, a kind's threshold is the score
that only ``false_share`` of its counterexamples exceed (of all kinds', if it has none), and at least
``least_score``. A proposal above it is added. Without examples of both sorts nothing is added.

Only DataFrame and SQL functions and Spark ML are used. The patterns are the
plain ones with possessive repeats and a start condition: a match can start
where the last one ended or where no character that could belong to it stands before. This finds the
same matches in linear time and constant stack, in texts of any length. A null or empty text has no spans;
repeated rows get equal spans, equal starts are ordered by kind. An empty table gives no rows, and no model either.
Extra columns pass through ``with_spans``; its result columns replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.spans import hits, placed
from tallyloom.operators.scale import cut_lineage

KINDS = ("email", "ip", "card", "phone")
# fixed values: base patterns, then looser ones
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\.)[A-Za-z0-9-]{1,63}){1,8}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){12,}+",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
CANDIDATE = "array<struct<start: int, no: int, end: int, kind: string, hit: string, before: string, behind: string, sure: boolean>>"


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of at most 19 digits passes the check."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) + 1 - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, 2 * d).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0), add) % 10 == 0


def passes(kind: str, hit: Column) -> Column:
    """The check of a base span."""
    n = F.length(digits(hit))
    if kind == "ip":
        return hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(hit))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def well_formed(kind: str, hit: Column) -> Column:
    """Whether a loose match can be what it looks like."""
    if kind == "email":
        return hit.rlike("[A-Za-z]{2,}$")
    if kind == "ip":
        return ~hit.rlike("^(?:[0-9A-Fa-f]{2}:){7}[0-9A-Fa-f]{2}$")  # a dump of bytes
    if kind == "card":
        return F.when(F.length(digits(hit)).between(13, 19), luhn(digits(hit))).otherwise(False)
    return F.lit(True)


def _typed(spans: Column, no: int, kind: str, base: bool) -> Column:
    def typed(s: Column) -> Column:
        sure = passes(kind, s["hit"]) if base else F.lit(False)
        return F.struct(s["start"].alias("start"), F.lit(no).alias("no"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["hit"].alias("hit"), s["before"].alias("before"), s["behind"].alias("behind"), sure.alias("sure"))
    return F.transform(spans, typed)


def with_candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``__sure`` (checked base spans), and of what overlaps none of them ``__failed`` (base spans) and ``__open`` (well-formed loose ones)."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    need = {"email": (("@",), ("(at)", "[at]")), "ip": ((".",), (":",)), "card": ((), ()), "phone": (("+",), ())}
    none = F.array().cast("array<string>")

    def gated(pattern: str, marks: tuple[str, ...]) -> Column:
        found = hits(F.col("__text"), pattern)
        if not marks:
            return found
        some = F.lit(False)
        for m in marks:
            some = some | F.contains("__text", F.lit(m))
        return F.when(some, found).otherwise(none)

    out = df.withColumn("__text", whole)
    out = out.withColumns({f"__h_{k}_{w}": gated((BASE, LOOSE)[w][k], need[k][w]) for k in KINDS for w in (0, 1)})
    def every(w: int) -> Column:
        return F.concat(*[_typed(placed(F.col("__text"), F.col(f"__h_{k}_{w}"), (BASE, LOOSE)[w][k]), i, k, w == 0) for i, k in enumerate(KINDS)])

    out = out.withColumns({"__base": every(0), "__loose": every(1)}).drop("__text", *[f"__h_{k}_{w}" for k in KINDS for w in (0, 1)])
    out = out.withColumn("__sure", F.filter("__base", lambda s: s["sure"]))

    def apart(s: Column) -> Column:
        return ~F.exists("__sure", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    def formed(s: Column) -> Column:
        kinds = F.lit(False)
        for k in KINDS:
            kinds = kinds | ((s["kind"] == k) & well_formed(k, s["hit"]))
        return kinds
    return out.withColumns({"__failed": F.filter("__base", lambda s: ~s["sure"] & apart(s)), "__open": F.filter("__loose", lambda s: formed(s) & apart(s))}).drop("__base", "__loose")


# fixed values: words around personal data and around other numbers
WORDS = (
    "e-?mail|mail|contact|write|reach|reply|send", "tel|phone|call|mobil|cell|fax|text|whatsapp|sms", "card|visa|credit|amex|pay", "ips?|host|addr|login|user|client|server",
    "my|me|her|his|their|our|your|name|mr|mrs|ms|dr", "order|serial|version|build|release|invoice|item|part|sku|isbn|issn|id|ref|ticket|case|model|hash|checksum|batch|lot|tracking|code|number|no",
)


def features(c: Column) -> list[Column]:
    """Context of a candidate, as numbers; its format takes no part."""
    flag = lambda x: x.cast("double")
    return [
        flag(c["before"].rlike("[0-9A-Za-z]$")), flag(c["behind"].rlike("^[0-9A-Za-z]")), flag(c["before"].rlike("[-./=#_$%]$")), flag(c["behind"].rlike("^[-./=#_%]+[0-9A-Za-z]")),
        flag(c["before"].rlike("[\"'(<\\[{]$")), flag(c["before"].rlike(":\\s*$")), flag(c["before"].rlike("[0-9]\\s*$")), flag(c["behind"].rlike("^\\s*[0-9]")), flag(F.length(c["before"]) == 0),
        *[flag(c["before"].rlike(rf"(?i)\b(?:{w})")) for w in WORDS[:-1]], flag(c["before"].rlike(rf"(?i)\b(?:{WORDS[-1]})\b")),
        *[flag(c["behind"].rlike(rf"(?i)\b(?:{w})\b")) for w in WORDS],
    ]


@dataclass
class PiiModel:
    trees: list  # (weight, nested splits)
    thresholds: dict[str, float]

    def score(self, own: list[Column]) -> Column:
        """Probability of personal data from a candidate's features."""
        def value(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            index, bound, left, right = node
            return F.when(own[index] <= bound, value(left)).otherwise(value(right))

        margin = F.lit(0.0)
        for weight, tree in self.trees:
            margin = margin + F.lit(weight) * value(tree)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))


def _nested(node) -> tuple | float:
    """A tree of Spark ML as nested (feature, bound, left, right)."""
    if node.numDescendants() == 0:
        return node.prediction()
    return node.split().featureIndex(), node.split().threshold(), _nested(node.leftChild()), _nested(node.rightChild())


def train(docs: DataFrame, text: str = "text", rounds: int = 8, depth: int = 3, false_share: float = 0.002, least_score: float = 0.9) -> PiiModel:
    """Fit on the base spans of all texts. A quarter of the texts, chosen by a hash, is kept out of the fit for the thresholds.

    Spans of one kind with the same features are one row with their number as weight, so the
    fit works on the distinct contexts and every span counts.
    """
    known = docs.select(F.col(text).cast("string").alias("text")).filter(F.length("text") > 0)
    every = with_candidates(known.withColumn("held", F.pmod(F.xxhash64("text", F.lit(6)), F.lit(4)) == 0))
    one = every.select("held", F.explode(F.concat("__sure", "__failed")).alias("c"))
    table = one.select("held", F.col("c.kind").alias("kind"), F.col("c.sure").cast("double").alias("label"), *[f.alias(f"f{i}") for i, f in enumerate(features(F.col("c")))])
    names = [c for c in table.columns if c[0] == "f" and c[1:].isdigit()]
    # sorted, so that reruns see the rows in one order
    table = table.groupBy(*table.columns).agg(F.count("*").cast("double").alias("weight")).orderBy("held", "label", "kind", *names)
    table = cut_lineage(table, "pii-candidates")
    have = {(r.held, r.label) for r in table.select("held", "label").distinct().collect()}
    if not {(False, 0.0), (False, 1.0)} <= have:
        return PiiModel([], {})
    vectors = VectorAssembler(inputCols=names, outputCol="v").transform(table)
    fitted = GBTClassifier(featuresCol="v", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.5, seed=3).fit(vectors.filter("not held"))
    trees = [(float(w), _nested(t._java_obj.rootNode())) for w, t in zip(fitted.treeWeights, fitted.trees)]
    model = PiiModel(trees, {})
    scored = table.filter("held and label = 0").select("kind", F.col("weight").cast("long").alias("spans"), model.score([F.col(n) for n in names]).alias("p"))
    # the trees give few distinct scores, whatever the number of spans
    scored = scored.groupBy("kind", "p").agg(F.sum("spans").alias("spans"))
    cut = {r.kind: max(least_score, r.p) for r in scored.rollup("kind").agg(F.percentile("p", 1 - false_share, F.col("spans")).alias("p")).collect() if r.p is not None}
    model.thresholds = {k: cut.get(k, cut.get(None, least_score)) for k in KINDS}
    return model


def with_spans(df: DataFrame, model: PiiModel, text: str = "text", spans: str = "spans", base: str = "base") -> DataFrame:
    """Adds the base spans and all selected spans of each text, by start and kind."""
    out = with_candidates(df, text)
    plain = lambda s: F.struct(s["start"].alias("start"), s["no"].alias("no"), s["end"].alias("end"), s["kind"].alias("kind"))
    chosen = F.col("__sure")
    if model.trees:
        bound = F.create_map(*[x for k, t in model.thresholds.items() for x in (F.lit(k), F.lit(t))])
        chosen = F.concat("__sure", F.when(F.size("__open") > 0, F.filter("__open", lambda s: model.score(features(s)) > F.element_at(bound, s["kind"]))).otherwise(F.array().cast(CANDIDATE)))
    out = out.withColumn(base, F.array_sort(F.transform("__sure", plain))).withColumn(spans, F.array_sort(F.array_distinct(F.transform(chosen, plain))))
    return out.drop("__sure", "__failed", "__open")


def redacted(text: Column, spans: Column) -> Column:
    """Text with each run of overlapping spans replaced by the kind of its first one, such as [EMAIL]."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))
    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
