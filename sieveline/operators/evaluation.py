"""Measuring a shortlist against labelled queries.

``queries``: (query_id, subject_type, is_true_match, source_uid, perturbation_type, query_name). ``candidates``: one row a candidate
(query_id, position from 1, uid, score, ambiguous, matched_name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)
POINT_KS = (3, 5, 10)
FLOORS = (0.0, 0.5, 0.6, 0.7, 0.8)
THRESHOLDS = (0.80, 0.85, 0.90, 0.95)


def share(part: Column, whole: Column) -> Column:
    """Ratio to four places; 0 for an empty group."""
    return F.when(whole == 0, 0.0).otherwise(F.round(part / whole, 4))


def unanswered(queries: DataFrame, answered: DataFrame) -> DataFrame:
    """Queries without a candidates line: there must be none."""
    return queries.select("query_id").join(answered.select("query_id"), "query_id", "left_anti")


def ranks(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Positives with the position of their source among the candidates, null if it is not there."""
    pos = queries.where("is_true_match").select("query_id", "subject_type", "perturbation_type", "query_name", "source_uid")
    found = candidates.select("query_id", F.col("uid").alias("source_uid"), "position").groupBy("query_id", "source_uid").agg(F.min("position").alias("rank"))
    return pos.join(found, ["query_id", "source_uid"], "left")


def recall(ranked: DataFrame) -> DataFrame:
    """(subject, recall_at_1, ..., recall_shortlist, n) by subject type and for all."""
    n = F.count("*")
    at = [share(F.count_if(F.col("rank") <= k), n).alias(f"recall_at_{k}") for k in KS]
    grouped = ranked.rollup("subject_type").agg(F.grouping("subject_type").alias("g"), *at, share(F.count("rank"), n).alias("recall_shortlist"), n.alias("n"))
    # without any positive the total is still a row of zeros
    return grouped.where("g = 1 or subject_type is not null").withColumn("subject", F.when(F.col("g") == 1, "all").otherwise(F.col("subject_type"))).select(
        "subject", *[f"recall_at_{k}" for k in KS], "recall_shortlist", "n"
    )


def recall_by_perturbation(ranked: DataFrame) -> DataFrame:
    """(perturbation ``subject:kind``, recall anywhere in the shortlist, n)."""
    return ranked.groupBy(F.concat_ws(":", "subject_type", "perturbation_type").alias("perturbation")).agg(
        share(F.count("rank"), F.count("*")).alias("recall"), F.count("*").alias("n")
    )


def operating_points(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(k, floor, recall, pairs, queries_with_candidates) for every k and floor, also where nothing survives.

    Ambiguous candidates stay beyond k, but not under the floor. The 15 points are an array on each row, not a second pass.
    """
    spark = queries.sparkSession
    points = [(k, f) for k in POINT_KS for f in FLOORS]
    grid = spark.createDataFrame(points, "k int, floor double")
    array = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f).alias("floor")) for k, f in points])
    truth = queries.select("query_id", F.when(F.col("is_true_match"), F.col("source_uid")).alias("source_uid"))
    rows = candidates.select("query_id", "uid", "position", "score", "ambiguous").join(truth, "query_id")
    kept = rows.select("*", F.explode(array).alias("p")).where("(position <= p.k or ambiguous) and score >= p.floor")
    per_query = kept.groupBy("p.k", "p.floor", "query_id").agg(F.count("*").alias("pairs"), F.max((F.col("uid") == F.col("source_uid")).cast("int")).alias("hit"))
    sums = per_query.groupBy("k", "floor").agg(F.sum("pairs").alias("pairs"), F.count("*").alias("asked"), F.sum("hit").alias("hits"))
    total = queries.agg(F.count_if("is_true_match").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return (
        grid.join(sums, ["k", "floor"], "left").join(F.broadcast(total))  # one row
        .select("k", "floor", share(zero("hits"), F.col("n")).alias("recall"), zero("pairs").alias("pairs"), zero("asked").alias("queries_with_candidates"))
    )


def threshold_baseline(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(subject_type, threshold, alerts, true_hits_alerted, recall, false_positives, fp_per_true_hit): every score over a threshold is an alert."""
    spark = queries.sparkSession
    grid = spark.createDataFrame([(s, t) for s in ("individual", "entity") for t in THRESHOLDS], "subject_type string, threshold double")
    rows = candidates.select("query_id", "uid", "score").join(queries.select("query_id", "subject_type", "is_true_match", "source_uid"), "query_id")
    true = F.coalesce(F.col("is_true_match") & (F.col("uid") == F.col("source_uid")), F.lit(False))
    met = rows.select("*", true.alias("true"), F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("threshold")).where("score >= threshold")
    sums = met.groupBy("subject_type", "threshold").agg(
        F.count("*").alias("alerts"), F.count_if("true").alias("hits"), F.countDistinct(F.when(F.col("true"), F.col("query_id"))).alias("caught")
    )
    n = queries.groupBy("subject_type").agg(F.count_if("is_true_match").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = grid.join(sums, ["subject_type", "threshold"], "left").join(n, "subject_type", "left")
    out = out.select("subject_type", "threshold", zero("alerts").alias("alerts"), zero("hits").alias("true_hits_alerted"), share(zero("caught"), zero("n")).alias("recall"))
    wrong = F.col("alerts") - F.col("true_hits_alerted")
    return out.withColumns({"false_positives": wrong, "fp_per_true_hit": F.round(F.try_divide(wrong, "true_hits_alerted"), 2)})


def misses(ranked: DataFrame, candidates: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(query_id, perturbation, query_name, source_name, top_candidate) of positives whose source is in no shortlist."""
    lost = ranked.where("rank is null")
    top = candidates.where("position = 1").select("query_id", F.col("matched_name").alias("top_candidate"))
    out = lost.join(top, "query_id", "left")
    if names is None:
        out = out.withColumn("source_name", F.lit(None).cast("string"))
    else:
        out = out.join(names.select(F.col("uid").alias("source_uid"), F.col("primary_name").alias("source_name")), "source_uid", "left")
    return out.select("query_id", F.col("perturbation_type").alias("perturbation"), "query_name", "source_name", "top_candidate")
