"""Rule tables, gates and scores. Rules are rows; flags are rows; scoring is a join and a sum, whatever the number of rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Up to so many rules (some hundred bytes each) are broadcast; beyond, flags are shuffled to them.
BROADCAST_RULES = 10_000
#: Upper ends (exclusive) of the five risk levels; the last level has none.
LEVELS = ((20, "very_low"), (40, "low"), (60, "medium"), (80, "high"), (100, "very_high"))
#: Finance rules as code, delta, flag, gate that must be open ('' for none).
FINANCE_RULES = (
    ("CONTINUOUS_LOSS", 25.0, "continuous_net_loss", ""),
    ("SINGLE_YEAR_LOSS", 15.0, "latest_full_year_loss", ""),
    ("CFO_NEGATIVE", 15.0, "cfo_persistently_negative", ""),
    ("GP_MARGIN_DROP", 10.0, "gp_margin_drop_gt_5pp", ""),
    ("CASH_RUNWAY_LT_12", 20.0, "runway_lt_12", "unprofitable"),
    ("CASH_RUNWAY_12_24", 10.0, "runway_12_24", "unprofitable"),
    ("BURN_YOY_UP_30", 15.0, "burn_yoy_up_gt_30", "unprofitable"),
)
#: Legal rules, with the theme whose disclosure counts when no rule of it fired.
LEGAL_RULES = (
    ("REDEMPTION_HIGH", 25.0, "redemption_high", ""),
    ("REDEMPTION_MEDIUM", 12.0, "redemption_medium", ""),
    ("RELATED_PARTY_HIGH", 25.0, "related_party_ratio_gt_30", ""),
    ("RELATED_PARTY_TREND", 10.0, "related_party_rising", ""),
    ("CONCENTRATION_HIGH", 25.0, "concentration_high", ""),
    ("PIPELINE_HIGH", 20.0, "pipeline_high", "biotech"),
    ("VALUATION_INVERSION", 25.0, "valuation_inversion", ""),
)
#: Disclosure flag, its floor, and the codes of which one fired replaces the floor.
DISCLOSURE_FLOORS = (
    ("exists_redemption", 18.0, ("REDEMPTION_HIGH", "REDEMPTION_MEDIUM")),
    ("exists_related_party", 15.0, ("RELATED_PARTY_HIGH",)),
    ("exists_concentration_disclosure", 12.0, ("CONCENTRATION_HIGH",)),
    ("exists_pipeline", 12.0, ("PIPELINE_HIGH",)),
)
#: A flag that silences another one when both are set.
SUPPRESSED = {"latest_full_year_loss": "continuous_net_loss"}
#: Weights of the two parts of the fundamental score, and of the fused one.
LEGAL_WEIGHT, FINANCE_WEIGHT, FUNDAMENTAL_WEIGHT, SENTIMENT_WEIGHT = 0.45, 0.55, 0.65, 0.35
#: Scenarios of the burn rate.
SCENARIOS = (("optimistic", 0.7), ("neutral", 1.0), ("pessimistic", 1.5))


def clamp(x: Column | float, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def level(score: Column, levels: Sequence[tuple[float, str]] = LEVELS) -> Column:
    """The first level whose end lies above the score; the last from there on. Null for a null score."""
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for end, name in levels:
        out = out.when(score < end, name)
    return out.otherwise(levels[-1][1])


def severity(delta: Column) -> Column:
    return F.when(delta >= 20, "high").otherwise("medium")


def first_match(cases: Sequence[tuple[Column, str]], default: str) -> Column:
    """One CASE in the order of the list: the order is the priority."""
    out = F.when(cases[0][0], cases[0][1])
    for c, name in cases[1:]:
        out = out.when(c, name)
    return out.otherwise(default)


def keyword_class(text: Column | str, words: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return first_match([(F.coalesce(F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(c, w)), F.lit(False)), name) for name, ws in words], default)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, float, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "code string, delta double, flag string, gate string")


def flags_long(flags: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """key, flag of every flag that is set (null is not)."""
    return flags.select(key, F.explode(F.array(*(F.when(F.coalesce(F.col(n), F.lit(False)), F.lit(n)) for n in names))).alias("flag")).where("flag IS NOT NULL")


def _few(rules: DataFrame) -> DataFrame:
    """``rules`` with a broadcast hint if they are few enough for one; they are counted."""
    return F.broadcast(rules) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else rules


def fired(flags: DataFrame, key: str, names: Sequence[str], rules: DataFrame, gates: Sequence[str] = (), evidence: str | None = None) -> DataFrame:
    """key, code, delta of each rule that counts: its flag set and not silenced, its gate open, evidence present.

    ``gates``: boolean columns of ``flags`` named as the rules name them; ``evidence``: a column with the number of pieces.
    """
    usable = flags.withColumns({a: F.coalesce(F.col(a), F.lit(False)) & ~F.coalesce(F.col(b), F.lit(False)) for a, b in SUPPRESSED.items() if a in names and b in names})
    if evidence:
        usable = usable.where(F.coalesce(F.col(evidence), F.lit(0)) > 0)
    long = flags_long(usable, key, names).join(_few(rules), "flag")
    if gates:
        is_open = F.array(F.lit(""), *(F.when(F.coalesce(F.col(g), F.lit(False)), F.lit(g)) for g in gates))
        long = long.join(usable.select(key, is_open.alias("_open")), key).where(F.array_contains("_open", F.col("gate")))
    else:
        long = long.where("gate = ''")
    return long.select(key, "code", "delta")


def scored(subjects: DataFrame, key: str, hits: DataFrame) -> DataFrame:
    """risk_score, risk_level and the codes of every subject, also of those without any hit."""
    total = hits.groupBy(key).agg(F.sum("delta").alias("total"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    score = clamp(F.coalesce("total", F.lit(0.0)))
    return subjects.select(key).join(total, key, "left").select(key, score.alias("risk_score"), level(score).alias("risk_level"), F.coalesce("codes", F.lit("")).alias("codes"))


def disclosure_floors(flags: DataFrame, key: str, hits: DataFrame) -> DataFrame:
    """key, code, delta of the floors: something is disclosed and no rule of its theme fired."""
    spark = flags.sparkSession
    floors = spark.createDataFrame([(f, d, list(c)) for f, d, c in DISCLOSURE_FLOORS], "flag string, delta double, codes array<string>")
    told = flags_long(flags, key, [f for f, _, _ in DISCLOSURE_FLOORS]).join(F.broadcast(floors), "flag")
    covered = told.select(key, "flag", F.explode("codes").alias("code")).join(hits.select(key, "code"), [key, "code"]).select(key, "flag").distinct()
    return told.join(covered, [key, "flag"], "left_anti").select(key, F.upper("flag").alias("code"), "delta")


def keep_strongest(hits: DataFrame, key: str, aliases: Column | None = None) -> DataFrame:
    """One row per canonical code with the largest delta; of equal deltas the first source by name (model before rule)."""
    code = aliases if aliases is not None else F.col("code")
    return hits.withColumn("code", code).groupBy(key, "code").agg(F.max_by(F.struct("delta", "source"), F.struct("delta", F.when(F.col("source") == "model", 1).otherwise(0))).alias("x")).select(key, "code", "x.delta", "x.source")


def fused_score(fundamental: Column, sentiment: Column) -> Column:
    """Risk of both parts; a high sentiment is a low risk."""
    return clamp(FUNDAMENTAL_WEIGHT * fundamental + SENTIMENT_WEIGHT * (100.0 - sentiment))


def fundamental_score(legal: Column, finance: Column) -> Column:
    return F.least(F.lit(100.0), LEGAL_WEIGHT * legal + FINANCE_WEIGHT * finance)


def profitability(series: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """key, latest_full_year_loss, continuous_net_loss, is_unprofitable, status from the full years (periods of digits) with values.

    continuous: the last three years, or the two there are, all negative. A profit in the latest year overrides. Keys without a
    full year: status unknown, nothing is assumed.
    """
    full = series.where(F.col(period).cast("string").rlike(r"^\d+$") & F.col(value).isNotNull())
    w = Window.partitionBy(key).orderBy(F.desc(period))
    last = full.withColumn("_n", F.row_number().over(w)).where("_n <= 3").groupBy(key).agg(F.max(F.when(F.col("_n") == 1, F.col(value))).alias("_latest"), F.bool_and(F.col(value) < 0).alias("_all"), F.count("*").alias("_years"))
    loss, continuous = F.coalesce(F.col("_latest") < 0, F.lit(False)), F.coalesce((F.col("_years") >= 2) & F.col("_all"), F.lit(False))
    unprofitable = (loss | continuous) & ~F.coalesce(F.col("_latest") > 0, F.lit(False))
    out = series.select(key).distinct().join(last, key, "left").withColumns({"latest_full_year_loss": loss, "continuous_net_loss": continuous})
    return out.withColumn("is_unprofitable", unprofitable).withColumn("status", F.when(F.col("_latest").isNull(), "unknown").when(F.col("is_unprofitable"), "unprofitable").otherwise("profitable")).drop("_latest", "_all", "_years")


def burn_scenarios(rows: DataFrame, outflow: str, months: str, cash: str, digits: int = 2) -> DataFrame:
    """Each row under each scenario: monthly_burn, runway_months (null for no burn), sensitive (the burn rates differ by over half)."""
    spark = rows.sparkSession
    s = F.broadcast(spark.createDataFrame(list(SCENARIOS), "scenario string, factor double"))
    burn = F.col(outflow) * F.col("factor") / F.greatest(F.col(months), F.lit(1))
    out = rows.crossJoin(s).withColumn("monthly_burn", F.round(burn, digits)).withColumn("runway_months", F.when(burn > 0, F.round(F.col(cash) / burn, digits)))
    factors = [f for _, f in SCENARIOS]
    return out.withColumn("sensitive", (F.col(outflow) > 0) & F.lit((max(factors) - min(factors)) / max(factors) > 0.5))


def gaps(hard: Sequence[tuple[Column, str]], soft: Sequence[tuple[Column, str]]) -> dict[str, Column]:
    """hard_gaps and soft_gaps as texts in list order, with their counts: the conditions that hold. Null conditions do not."""

    def names(cases):
        return F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in cases)), lambda x: x.isNotNull())

    return {"hard_gaps": F.array_join(names(hard), ";"), "soft_gaps": F.array_join(names(soft), ";"), "n_hard": F.size(names(hard)), "n_soft": F.size(names(soft))}


def peer_zscore(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Adds peers, mean, median, sd of the group, z (0 for no deviation), outlier (|z| > 2) and limited (fewer than 3 peers)."""
    g = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("peers"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("sd"))
    z = F.when(F.coalesce(F.col("sd"), F.lit(0.0)) == 0, F.when(F.col(value).isNotNull(), 0.0)).otherwise((F.col(value) - F.col("mean")) / F.col("sd"))
    return rows.join(g, group, "left").withColumn("z", z).withColumn("outlier", F.coalesce(F.abs("z") > 2, F.lit(False))).withColumn("limited", F.coalesce("peers", F.lit(0)) < 3)
