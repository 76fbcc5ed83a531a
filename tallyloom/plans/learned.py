"""Learned methods and the plug-in surface, bound to the star."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import backtest as B
from tallyloom.operators import learned as G
from tallyloom.operators import methods as M
from tallyloom.operators import metrics as X
from tallyloom.operators import registry as R
from tallyloom.operators import windows as W
from tallyloom.operators.hurdle import pooled_hurdle
from tallyloom.operators.scale import cut_lineage, spread
from tallyloom.operators.trees import pooled_trees
from tallyloom.plans import methods as P
from tallyloom.plans.methods import PLAN, TRAIN
from tallyloom.plans.registry import plan
from tallyloom.plans.scoring import SC

FLAGS = ["is_enrollment_period", "is_exam_week", "is_event_day", "is_sem_break", "closed"]


@plan("fc_hurdle_logistic", "sku:s fold:l h:l yhat:d4")
def _(s):
    cal = P.day_rows(s).select("day", *[F.col(f).cast("double").alias(f) for f in FLAGS])
    return pooled_hurdle(s.series.join(F.broadcast(cal), "day"), "sku", "category", PLAN, FLAGS)


@plan("fc_calendar_regression", "category:s fold:l day:D yhat:d4")
def _(s):
    cal = P.day_rows(s).select("day", *[F.col(f).cast("double").alias(f) for f in FLAGS])
    rows = cut_lineage(s.category_series.join(F.broadcast(cal), "day"), "series")
    return G.calendar_regression(rows, "category", FLAGS, PLAN)


@plan("fc_trees_pooled", "sku:s fold:l total:d3")
def _(s):
    f = W.causal_features(s.series)
    ahead = Window.partitionBy("sku").orderBy("pos").rowsBetween(0, 29)
    f = cut_lineage(f.withColumn("target", F.sum("qty").over(ahead)), "features")
    cols = [c for c in f.columns if c.split("_")[0] in ("lag", "mean", "std", "max", "share", "sum", "days", "trend", "ratio", "weekday")]
    return pooled_trees(f, "sku", cols, PLAN)


FEATS = ["days_since_last", "days_since_first", "units_30", "units_90", "units_365", "days_sold_30", "days_sold_90", "days_sold_365"]


def item_origins(s, origins=6, horizon=84):
    """Features of every item at a few origins, from strictly earlier sales;
    the outcome is the first sale day after the origin."""
    b = s.sale.agg(F.min("day").alias("a"), F.max(F.when(F.col("quantity_sold") > 0, F.col("day"))).alias("z")).first()
    n = (b.z - b.a).days + 1
    d = s.sale.filter("quantity_sold > 0").groupBy("product_id", F.datediff("day", F.lit(b.a)).alias("pos")).agg(F.sum("quantity_sold").alias("q"))
    os = F.array(*[F.lit(n - horizon - 30 * k) for k in range(origins)])
    # an item's days are sent once; its origins are counted where they are
    r = spread(d, "product_id").withColumn("origin", F.explode(os))
    past, age = F.col("pos") < F.col("origin"), F.col("origin") - F.col("pos")
    g = r.groupBy("product_id", "origin").agg(
        F.min(F.when(past, age)).alias("days_since_last"), F.max(F.when(past, age)).alias("days_since_first"),
        *[F.sum(F.when(past & (age <= w), F.col("q")).otherwise(0)).alias(f"units_{w}") for w in (30, 90, 365)],
        *[F.count(F.when(past & (age <= w), 1)).alias(f"days_sold_{w}") for w in (30, 90, 365)],
        F.min(F.when(~past, F.col("pos") - F.col("origin"))).alias("wait"))
    return g.filter("days_since_last IS NOT NULL").withColumn("is_test", (F.col("origin") == n - horizon).cast("int"))


@plan("ml_sells_next_30", "rule:s auc:d4 accuracy:d4 items:l")
def _(s):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    rows = item_origins(s).withColumn("label", F.coalesce((F.col("wait") < 30).cast("double"), F.lit(0.0)))
    rows = cut_lineage(VectorAssembler(inputCols=FEATS, outputCol="features").transform(rows), "rows")
    model = GBTClassifier(maxIter=10, maxDepth=3, seed=0).fit(rows.filter("is_test = 0"))
    test = model.transform(rows.filter("is_test = 1"))
    auc = BinaryClassificationEvaluator().evaluate(test)
    rule = rows.filter("is_test = 1").withColumn("score", -F.col("days_since_last").cast("double"))
    auc2 = BinaryClassificationEvaluator(rawPredictionCol="score").evaluate(rule)
    a = test.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("items")).withColumn("rule", F.lit("model")).withColumn("auc", F.lit(auc))
    b = rule.agg(F.avg(((F.col("days_since_last") <= 30).cast("double") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("items")).withColumn(
        "rule", F.lit("sold in the last 30 days")).withColumn("auc", F.lit(auc2))
    return a.unionByName(b)


@plan("ml_weeks_to_sale", "rule:s pairs:l c_index:d4")
def _(s):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    weeks = 12
    w = F.floor(F.col("wait") / 7) + 1
    rows = item_origins(s).withColumn("time", F.least(F.coalesce(w, F.lit(weeks)), F.lit(weeks))).withColumn("observed", F.coalesce((w <= weeks).cast("int"), F.lit(0)))
    rows = cut_lineage(rows, "rows")
    asm = VectorAssembler(inputCols=[*FEATS, "week"], outputCol="features")
    person = spread(rows.filter("is_test = 0"), "product_id").withColumn("week", F.explode(F.sequence(F.lit(1).cast("long"), F.col("time"))))
    person = person.withColumn("label", ((F.col("week") == F.col("time")) & (F.col("observed") == 1)).cast("double"))
    model = LogisticRegression(maxIter=30, regParam=1e-3).fit(asm.transform(person))
    test = spread(rows.filter("is_test = 1"), "product_id").withColumn("week", F.explode(F.sequence(F.lit(1), F.lit(weeks))))
    p = model.transform(asm.transform(test)).withColumn("stay", 1 - vector_to_array("probability")[1])
    hz = p.groupBy("product_id", "time", "observed", "days_since_last").agg(F.sort_array(F.collect_list(F.struct("week", "stay"))).alias("h"))
    exp = F.aggregate("h", F.struct(F.lit(1.0).alias("surv"), F.lit(0.0).alias("t")), lambda a, x: F.struct((a["surv"] * x["stay"]).alias("surv"), (a["t"] + a["surv"]).alias("t")))["t"]
    scored = cut_lineage(hz.withColumn("risk", F.round(-exp, 6)), "risk")
    a = X.c_index(scored.select("time", "observed", "risk")).withColumn("rule", F.lit("model"))
    b = X.c_index(scored.select("time", "observed", (-F.col("days_since_last")).cast("double").alias("risk"))).withColumn("rule", F.lit("days since last sale"))
    return a.unionByName(b)


@plan("udf_method_registry", "sku:s method:s fold:l pred:d6", SC + "SELECT sku, method, fold, pred FROM fr")
def _(s):
    return R.run(s.series, "sku", PLAN, ["naive", "rolling_mean_30", "rolling_mean_90"])


@plan("udf_custom_fit_predict", "sku:s fold:l h:l yhat:d6", TRAIN + """
SELECT sku, fold, unnest(range(30)) AS h, yhat FROM (SELECT sku, fold, 0.5 * quantile_cont(qty, 0.5) FILTER (age < 60) + 0.5 * avg(qty) FILTER (age < 60) AS yhat FROM train GROUP BY ALL)""")
def _(s):
    def half_median(train, horizon):
        import numpy as np

        tail = train[-60:]
        return np.full(horizon, 0.5 * np.median(tail) + 0.5 * tail.mean())

    return R.custom(s.series, "sku", PLAN, half_median, window=60)


@plan("udaf_gini", "product_id:l gini:d6", """
WITH d AS (SELECT product_id, day, sum(quantity_sold) AS q FROM sale GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY q) AS i FROM d)
SELECT product_id, CASE WHEN sum(q) > 0 THEN (2 * sum(i * q) - (count(*) + 1) * sum(q)) / (count(*) * sum(q)) ELSE 0 END AS gini FROM r GROUP BY 1""")
def _(s):
    from tallyloom.operators.aggregates import gini

    return gini(s.sale.groupBy("product_id", "day").agg(F.sum("quantity_sold").alias("q")), ["product_id"], "q")


@plan("udtf_horizon", "sku:s step:l day:D level:d6", "SELECT sku, h AS step, d1 + CAST(h AS INT) AS day, level FROM (SELECT sku, avg(qty) FILTER (pos >= n - 30) AS level FROM series GROUP BY 1), (SELECT unnest(range(1, 31)) AS h), hist")
def _(s):
    g = s.series.groupBy("sku").agg(F.avg(F.when(F.col("pos") >= F.col("n") - 30, F.col("qty"))).alias("level"), F.max("day").alias("last"))
    return g.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(30)))).withColumn("day", F.date_add("last", F.col("step")))
