"""Representative training dates by clustering, with their rule weights."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weightloom.functions import vectors as V
from weightloom.operators.panel import FEATURES
from weightloom.operators.rules import policy_weights
from weightloom.session import materialize


def date_vectors(feats: DataFrame) -> DataFrame:
    """(t, x): all features of a date as one vector, assets in universe order."""
    one = F.array(*[F.coalesce(c, F.lit(0.0)) for c in FEATURES])
    g = feats.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("ord", one.alias("f")))).alias("v"), F.max("cross_vol").alias("cv"))
    flat = F.concat(F.flatten(F.transform("v", lambda e: e["f"])), F.array(F.coalesce("cv", F.lit(0.0))))
    return g.select("t", flat.alias("x"))


def representatives(feats: DataFrame, k: int = 8, seed: int = 42) -> DataFrame:
    """(cluster, t, distance): the date nearest to each centre of the
    standardised feature vectors.  Fewer dates than k give no rows."""
    x = date_vectors(feats).select("t", array_to_vector("x").alias("raw"))
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(x).transform(x)
    model = KMeans(k=k, seed=seed, maxIter=50, initMode="k-means||").fit(scaled)
    # k centres of the feature dimension: a literal of bounded size
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    centres = feats.sparkSession.createDataFrame(rows, "prediction int, centre array<double>")
    d = model.transform(scaled).join(F.broadcast(centres), "prediction").select(
        F.col("prediction").alias("cluster"), "t", V.l2(vector_to_array("features"), F.col("centre")).alias("distance")
    )
    return d.groupBy("cluster").agg(
        F.min_by("t", F.struct("distance", "t")).alias("t"), F.min("distance").alias("distance"), F.count("*").alias("members")
    )


def _members(feats: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, t, x): the training dates of each fold, every component standardised within the fold.
    A component that never varies there is 0."""
    span = folds.select("fold", "train_start", "train_end")
    x = date_vectors(feats).join(F.broadcast(span), (F.col("t") >= F.col("train_start")) & (F.col("t") < F.col("train_end"))).select("fold", "t", F.posexplode("x").alias("i", "v"))
    of = x.groupBy("fold", "i").agg(F.avg("v").alias("mu"), F.stddev_samp("v").alias("sd"))
    z = x.join(of, ["fold", "i"]).select("fold", "t", "i", F.when(F.col("sd") > 0, (F.col("v") - F.col("mu")) / F.col("sd")).otherwise(0.0).alias("z"))
    packed = z.groupBy("fold", "t").agg(F.array_sort(F.collect_list(F.struct("i", "z"))).alias("v"))
    return materialize(packed.select("fold", "t", F.transform("v", lambda e: e["z"]).alias("x")), "training-dates")


def _nearest(members: DataFrame, centres: DataFrame) -> DataFrame:
    """(fold, t, x, cluster, d2): the nearest centre of the fold, ties to the smaller number."""
    packed = centres.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("cluster", "c"))).alias("cs"))  # k centres a fold
    at = F.array_min(F.transform("cs", lambda e: F.struct(V.total(F.zip_with("x", e["c"], lambda a, b: (a - b) * (a - b))).alias("d2"), e["cluster"].alias("cluster"))))
    return members.join(packed, "fold").withColumn("_m", at).select("fold", "t", "x", "_m.cluster", "_m.d2")


def fold_representatives(feats: DataFrame, folds: DataFrame, k: int = 8, seed: int = 42, rounds: int = 50) -> DataFrame:
    """(fold, cluster, t, distance, members): the training date nearest to each centre, for all folds at once.

    Lloyd's rounds are keyed by (fold, cluster), so a round is one shuffle whatever the number of
    folds. The start is the k training dates with the least digests of (seed, fold, t). Rounds end
    when no centre moves. A centre without dates stays where it is and gives no row; folds with
    fewer dates than k give none.
    """
    members = _members(feats, folds)
    first = Window.partitionBy("fold").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("fold").cast("string"), F.col("t").cast("string"))))
    enough = members.withColumn("n", F.count("*").over(Window.partitionBy("fold"))).where(F.col("n") >= k).drop("n")
    centres = enough.withColumn("cluster", F.row_number().over(first) - 1).where(F.col("cluster") < k).select("fold", "cluster", F.col("x").alias("c"))
    centres = materialize(centres, "centres")
    for _ in range(rounds):
        cells = _nearest(members, centres).select("fold", "cluster", F.posexplode("x").alias("i", "v")).groupBy("fold", "cluster", "i").agg(F.avg("v").alias("m"))
        moved = cells.groupBy("fold", "cluster").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v")).select("fold", "cluster", F.transform("v", lambda e: e["m"]).alias("new"))
        step = centres.join(moved, ["fold", "cluster"], "left").select("fold", "cluster", F.coalesce("new", "c").alias("c"), V.l2(F.col("c"), F.coalesce("new", "c")).alias("moved"))
        step = materialize(step, "centres")
        centres = step.drop("moved")
        if not step.where("moved > 1e-9").limit(1).count():
            break
    d = _nearest(members, centres)
    return d.groupBy("fold", "cluster").agg(F.min_by("t", F.struct("d2", "t")).alias("t"), F.sqrt(F.min("d2")).alias("distance"), F.count("*").alias("members"))


def labelled_examples(feats: DataFrame, reps: DataFrame, profile: str, cap: float = 0.60, keep_quirk: bool = True) -> DataFrame:
    """(cluster, t, asset, ord, w): rule weights at the representative dates, by fold where these have one.

    With ``keep_quirk`` profile P5 reads features that do not exist and is
    therefore always equal; otherwise it is the reward-to-risk rule.
    """
    policy = "P4" if profile == "P5" and keep_quirk else profile
    at = feats.join(F.broadcast(reps.select("t").distinct()), "t", "left_semi")
    w = policy_weights(at, cap, policies=(policy,))
    keys = _keys(reps)
    return w.join(F.broadcast(reps.select(*keys, "t")), "t").select(*keys, "t", "asset", "ord", "w")


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("fold", "cluster") if c in df.columns]


def example_blocks(examples: DataFrame, feats: DataFrame, max_examples: int = 4, max_features: int = 12) -> DataFrame:
    """(cluster, text), or (fold, cluster, text): rendered examples in cluster order."""
    keys = _keys(examples)
    names = F.array(*[F.struct(F.concat("asset", F.lit(f"_{c}")).alias("k"), F.col(c).alias("v")) for c in sorted(FEATURES)])
    at = feats.join(F.broadcast(examples.select(*keys, "t").distinct()), "t")
    lines = at.select(*keys, F.inline(names)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("f"))
    shown = F.transform(F.slice("f", 1, max_features), lambda e: F.format_string("- %s: %.6f", e["k"], e["v"]))
    ws = examples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "asset", "w"))).alias("w"))
    pairs = F.transform("w", lambda e: F.format_string('"%s": %s', e["asset"], F.round(e["w"], 4).cast("string")))
    j = lines.join(ws, keys).where(F.col("cluster") < max_examples)
    return j.select(*keys, F.concat(
        F.format_string("### EXAMPLE %d\nFeatures:\n", F.col("cluster") + 1), F.concat_ws("\n", shown),
        F.lit("\nTargetWeights(JSON): {"), F.concat_ws(", ", pairs), F.lit("}")).alias("text"))


def fold_blocks(blocks: DataFrame) -> DataFrame:
    """(fold, examples): the blocks of a fold as one text, in cluster order."""
    return blocks.groupBy("fold").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("cluster", "text"))), lambda e: e["text"])).alias("examples"))
