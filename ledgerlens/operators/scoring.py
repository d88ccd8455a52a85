"""Scores of the analyst roles: totals, baselines, escalation and the allowed rating."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import picks
from ledgerlens.schema import EXPERTS

RUN = ("ts_code", "run_id")
COGNITIVE = "cognitive-controller"
MACRO = "macro-cyclist"
DIRECTIONS = ("POSITIVE", "NEUTRAL", "NEGATIVE")
# Verdicts a rating may have, and those without any position.
RATINGS = ("BUY", "OBSERVE", "HOLD", "PASS", "REDUCE", "AVOID")
NO_POSITION = ("HOLD", "PASS", "SELL", "REDUCE", "AVOID")


@dataclass(frozen=True)
class Tier:
    min_score: float
    verdict: str
    max_allocation_pct: float


@dataclass(frozen=True)
class Scoring:
    """Caller-supplied rules; a handful of values, so they become literals in the plan."""

    weights: Mapping[str, float]
    expected_total: float = 1.0
    adjustment: Mapping[str, float] = field(default_factory=lambda: {"VETO": 0.5, "WARN": 0.8})
    tiers: Sequence[Tier] = ()
    veto_rules: Mapping[str, Sequence[str]] = field(default_factory=dict)
    macro_veto_cap: float = 100.0

    def weight(self, expert: Column) -> Column:
        return _exact_weight(self.weights, expert)

    def tier(self, score: Column) -> Column:
        """First tier, best first, whose lower bound the score reaches."""
        out = F.lit(None).cast("struct<verdict:string,cap:double>")
        for t in sorted(self.tiers, key=lambda t: t.min_score):
            reached = F.struct(F.lit(t.verdict).alias("verdict"), F.lit(float(t.max_allocation_pct)).alias("cap"))
            out = F.when(score >= t.min_score, reached).otherwise(out)
        return out


def _exact_weight(weights: Mapping[str, float], expert: Column, default: float | None = None) -> Column:
    """Weight of a role as a decimal, so that totals do not depend on the order of addition."""
    out = F.lit(default).cast("decimal(9,6)")
    for name, w in weights.items():
        out = F.when(expert == name, F.lit(str(w)).cast("decimal(9,6)")).otherwise(out)
    return out


def valid_score(score: Column) -> Column:
    return F.when(score.between(0, 100), score)


# --- totals ----------------------------------------------------------------------


def composite(results: DataFrame, scoring: Scoring) -> DataFrame:
    """Weighted total per run and its adjustment by the cognitive verdict.

    One missing or invalid score of the seven leaves both totals NULL.  A
    ``cognitive_multiplier`` between 0.5 and 1 goes before the verdict mapping.
    """
    score = valid_score(F.col("score"))
    cognitive = F.col("expert_id") == COGNITIVE
    multiplier = F.col("cognitive_multiplier") if "cognitive_multiplier" in results.columns else F.lit(None).cast("double")
    per = results.filter(F.col("expert_id").isin(*EXPERTS)).groupBy(*RUN).agg(
        F.count_distinct(F.when(score.isNotNull(), F.col("expert_id"))).alias("scored"),
        F.sum(score * scoring.weight(F.col("expert_id"))).alias("total"),
        F.max(F.when(cognitive, F.col("verdict"))).alias("cognitive_verdict"),
        F.max(F.when(cognitive & multiplier.between(0.5, 1.0), multiplier)).alias("multiplier"),
    )
    mapped = F.lit("1").cast("decimal(9,6)")
    for verdict, factor in scoring.adjustment.items():
        mapped = F.when(F.col("cognitive_verdict") == verdict, F.lit(str(factor)).cast("decimal(9,6)")).otherwise(mapped)
    factor = F.coalesce(F.col("multiplier").cast("decimal(9,6)"), mapped)
    complete = F.col("scored") == len(EXPERTS)
    only = lambda x: F.when(complete, x.cast("double"))
    return per.select(
        *RUN,
        complete.alias("complete"),
        only(F.col("total")).alias("raw"),
        only(factor).alias("adjustment"),
        only(F.col("total") * factor).alias("adjusted"),
    )


def verdict_split(results: DataFrame) -> DataFrame:
    """Runs whose roles pass and veto at the same time, three verdicts or more."""
    per = results.groupBy(*RUN).agg(
        F.count_if(F.col("verdict") == "PASS").alias("pass_count"),
        F.count_if(F.col("verdict") == "VETO").alias("veto_count"),
    )
    p, v = F.col("pass_count"), F.col("veto_count")
    return per.withColumn("severe_split", (p > 0) & (v > 0) & (p + v >= 3))


# --- baselines -------------------------------------------------------------------


def baselines(history: DataFrame, minimum: int = 5) -> DataFrame:
    """Mean and sample deviation of every role's past scores; NULL below five scores."""
    per = history.groupBy("expert_id").agg(
        F.count("score").alias("n"), F.avg("score").alias("m"), F.stddev_samp("score").alias("s")
    )
    enough = F.col("n") >= minimum
    return per.select(
        "expert_id", "n",
        F.when(enough, F.round("m", 1)).alias("mean"),
        F.when(enough, F.round("s", 1)).alias("std"),
    )


def z_scores(current: DataFrame, base: DataFrame, minimum: int = 5) -> DataFrame:
    """Distance of each score from the role's baseline, with a label."""
    joined = current.join(base, "expert_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    z = F.when(F.col("std") > 0, F.round((F.col("score") - F.col("mean")) / F.col("std"), 2))
    tag = (
        F.when(F.col("score").isNull(), "no_score")
        .when(F.col("z") > 1.5, "high")
        .when(F.col("z") < -1.5, "low")
        .when(F.col("z").isNotNull(), "normal")
        .when(F.col("n") < minimum, "insufficient")
        .otherwise("no_baseline")
    )
    return joined.withColumn("z", z).withColumn("tag", tag)


def calibrated_totals(scored: DataFrame, weights: Mapping[str, float], default: float = 0.10) -> DataFrame:
    """Raw and calibrated weighted totals per run; calibration covers the roles that have a z-score."""
    w = _exact_weight(weights, F.col("expert_id"), default)
    # least and greatest skip NULL, so a role without a z-score is left out explicitly
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + F.col("z") * 10))
    calibrated = F.when(F.col("z").isNotNull(), clamped).cast("decimal(9,4)")
    return scored.groupBy(*RUN).agg(
        F.count("score").alias("valid"),
        F.sum(F.col("score") * w).cast("double").alias("raw_total"),
        F.sum(calibrated * w).cast("double").alias("calibrated_total"),
    )


# --- opposition and escalation -----------------------------------------------------


def run_directions(results: DataFrame) -> DataFrame:
    """One row per run with the stated directions; only runs where all seven roles state one."""
    stated = results.filter(F.col("conclusion_direction").isin(*DIRECTIONS) & F.col("expert_id").isin(*EXPERTS))
    per = stated.groupBy(*RUN, "industry", "created_at").agg(
        F.array_sort(F.collect_set(F.struct("expert_id", F.col("conclusion_direction").alias("d")))).alias("directions")
    )
    return per.filter(F.size("directions") == len(EXPERTS))


def opposed_experts(directions: Column) -> Column:
    """Roles whose direction contradicts the majority of the other six."""
    sign = lambda d: F.when(d == "POSITIVE", 1).when(d == "NEGATIVE", -1).otherwise(0)
    total = F.aggregate(directions, F.lit(0), lambda acc, e: acc + sign(e["d"]))
    against = F.filter(directions, lambda e: sign(e["d"]) * (total - sign(e["d"])) < 0)
    return F.transform(against, lambda e: e["expert_id"])


def industry_opposition(results: DataFrame, runs: int = 3) -> DataFrame:
    """Roles that opposed the majority in each of the newest three runs of an industry."""
    newest = picks.top_n(
        run_directions(results), ["industry"], [F.col("created_at").desc(), F.col("run_id").desc()], runs, rank="pos"
    )
    per = newest.withColumn("opposed", opposed_experts(F.col("directions"))).groupBy("industry").agg(
        F.count(F.lit(1)).alias("runs"),
        F.array_sort(F.collect_list(F.struct("pos", "run_id", "opposed"))).alias("r"),
    )
    everywhere = F.aggregate(
        F.slice("r", 2, runs), F.element_at("r", 1)["opposed"], lambda acc, x: F.array_intersect(acc, x["opposed"])
    )
    enough = F.col("runs") >= runs
    return per.select(
        "industry",
        F.array_join(F.transform("r", lambda x: x["run_id"]), ",").alias("run_ids"),
        F.when(enough, F.array_join(F.array_sort(everywhere), ",")).otherwise("").alias("opposed_experts"),
        (enough & (F.size(everywhere) > 0)).alias("opposition"),
        F.when(enough, F.lit(f"EVALUATED_{runs}_RUNS"))
        .otherwise(F.concat(F.lit("INSUFFICIENT_VERIFIED_HISTORY_"), F.col("runs").cast("string"), F.lit(f"_OF_{runs}")))
        .alias("status"),
    )


def escalations(results: DataFrame, scoring: Scoring) -> DataFrame:
    """Runs that need the third review level: severe split, low total, or lasting opposition."""
    total = composite(results, scoring)
    split = verdict_split(results)
    industries = results.groupBy(*RUN).agg(F.max("industry").alias("industry"))
    lasting = industry_opposition(results).select("industry", "opposition")
    joined = total.join(split, list(RUN)).join(industries, list(RUN)).join(lasting, "industry", "left")
    low = F.coalesce(F.col("complete") & (F.col("adjusted") < 40), F.lit(False))
    against = F.coalesce("opposition", F.lit(False))
    return joined.select(
        *RUN, "industry", "severe_split", "pass_count", "veto_count",
        F.round("adjusted", 2).alias("composite_score"),
        low.alias("score_below_40"),
        against.alias("industry_opposition"),
        (F.col("severe_split") | low | against).alias("triggered"),
    )


# --- rating ----------------------------------------------------------------------


def _allowed(scoring: Scoring, tier: Column, vetoes: Column) -> Column:
    """Ratings the veto rules leave over; the tier's own rating when no rule applies or none is left."""
    own = F.array(tier["verdict"])
    every = F.array(*[F.lit(r) for r in RATINGS])
    left = every
    ruled = F.lit(False)
    for expert, verdicts in scoring.veto_rules.items():
        hit = F.array_contains(vetoes, expert)
        left = F.when(hit, F.array_intersect(left, F.array(*[F.lit(v) for v in verdicts]))).otherwise(left)
        ruled = ruled | hit
    return F.when(ruled & (F.size(left) > 0), F.array_sort(left)).otherwise(own)


def ratings(results: DataFrame, scoring: Scoring) -> DataFrame:
    """Per run the tier of its total, the allowed ratings and the position cap."""
    vetoed = results.groupBy(*RUN).agg(
        F.array_sort(F.collect_set(F.when(F.col("verdict") == "VETO", F.col("expert_id")))).alias("vetoes")
    )
    score = F.bround("adjusted", 0)
    rows = composite(results, scoring).filter("complete").join(vetoed, list(RUN))
    rows = rows.withColumns({"score": score, "tier": scoring.tier(score)})
    any_veto = F.size("vetoes") > 0
    allowed = F.when(any_veto, _allowed(scoring, F.col("tier"), F.col("vetoes"))).otherwise(F.array(F.col("tier.verdict")))
    rows = rows.withColumn("allowed", F.when(any_veto, F.array_except(allowed, F.array(F.lit("BUY")))).otherwise(allowed))
    holds_position = F.exists("allowed", lambda v: ~v.isin(*NO_POSITION))
    cap = F.when(holds_position, F.col("tier.cap")).otherwise(0.0)
    cap = F.when(F.array_contains("vetoes", MACRO), F.least(cap, F.lit(scoring.macro_veto_cap))).otherwise(cap)
    return rows.select(
        *RUN, "score",
        F.col("tier.verdict").alias("tier_verdict"),
        F.array_join("vetoes", ",").alias("vetoes"),
        F.array_join("allowed", ",").alias("allowed"),
        cap.alias("max_allocation_pct"),
    )


def decision_problems(decisions: DataFrame, results: DataFrame, scoring: Scoring) -> DataFrame:
    """Declared decisions against the recomputed ones: one row per run and disagreement.

    ``decisions``: ts_code, run_id, verdict, composite_score, composite_score_raw,
    cognitive_adjustment, vetoes (array), max_allocation_pct, sub_scores (map of
    role to score and verdict).
    """
    total = composite(results, scoring)
    roles = results.groupBy(*RUN).agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("expert_id", F.struct("score", "verdict").alias("v"))))).alias("roles")
    )
    rated = ratings(results, scoring).select(*RUN, F.split("allowed", ",").alias("allowed"), F.col("vetoes").alias("found"), F.col("max_allocation_pct").alias("cap"))
    rows = decisions.join(total, list(RUN), "left").join(roles, list(RUN), "left").join(rated, list(RUN), "left")
    declared_vetoes = F.array_join(F.array_sort("vetoes"), ",")
    wrong_role = [
        F.when(~F.try_element_at("sub_scores", F.lit(e)).eqNullSafe(F.try_element_at("roles", F.lit(e))), F.lit(f"sub_scores.{e}"))
        for e in EXPERTS
    ]
    off = lambda a, b, tol: ~F.coalesce(F.abs(F.col(a) - b) <= tol, F.lit(False))
    done = F.coalesce("complete", F.lit(False))
    checks = [
        F.when(~done, F.lit("scores_incomplete")),
        F.when(done & off("composite_score", F.bround("adjusted", 0), 1e-9), F.lit("composite_score")),
        F.when(done & off("composite_score_raw", F.col("raw"), 0.011), F.lit("composite_score_raw")),
        F.when(done & off("cognitive_adjustment", F.col("adjustment"), 1e-9), F.lit("cognitive_adjustment")),
        F.when(done & ~declared_vetoes.eqNullSafe(F.col("found")), F.lit("vetoes_triggered")),
        F.when(done & (F.size("vetoes") > 0) & (F.col("verdict") == "BUY"), F.lit("buy_under_veto")),
        F.when(done & ~F.coalesce(F.array_contains("allowed", F.col("verdict")), F.lit(False)), F.lit("verdict_not_allowed")),
        F.when(done & (F.col("max_allocation_pct") > F.col("cap")), F.lit("allocation_above_cap")),
        F.when(F.col("verdict").isin(*NO_POSITION) & (F.col("max_allocation_pct") != 0), F.lit("allocation_without_position")),
        F.when((F.col("verdict") == "BUY") & (F.col("max_allocation_pct") <= 0), F.lit("buy_without_allocation")),
    ]
    found = F.array_compact(F.array(*checks, *[F.when(done, w) for w in wrong_role]))
    return rows.select(*RUN, F.explode(found).alias("problem"))


def unregistered_reviews(reviews: DataFrame, registered: DataFrame) -> DataFrame:
    """Review verdicts that change something but are not registered in the decision as such."""
    changing = reviews.filter(F.col("verdict").isin("DOWNGRADED", "UPGRADED", "DOWNGRADE", "ESCALATE"))
    return changing.select(*RUN, "review_id", "verdict").join(
        registered.select(*RUN, "review_id", "verdict"), [*RUN, "review_id", "verdict"], "left_anti"
    )


def scoring_problems(spark: SparkSession, scoring: Scoring) -> DataFrame:
    """What is wrong with the rules themselves; no row when they are sound."""
    expected = [e for e in EXPERTS if e != COGNITIVE]
    w = list(scoring.weights.values())
    mins = [t.min_score for t in scoring.tiers]
    checks = {
        "weight_keys": set(scoring.weights) != set(expected),
        "weight_range": any(not 0 < x < 1 for x in w),
        "weight_total": abs(sum(w) - scoring.expected_total) > 1e-9,
        "adjustment": any(not 0 < scoring.adjustment.get(k, 0) <= 1 for k in ("VETO", "WARN")),
        "tiers": len(mins) < 2 or mins != sorted(mins, reverse=True) or mins[-1] != 0
        or any(t.verdict not in RATINGS for t in scoring.tiers),
        "veto_rules": any(k not in EXPERTS or not v or any(x not in {t.verdict for t in scoring.tiers} for x in v)
                          for k, v in scoring.veto_rules.items()),
        "macro_veto_cap": not 0 <= scoring.macro_veto_cap <= 100,
    }
    return spark.createDataFrame([(k,) for k, bad in checks.items() if bad], "problem string")
