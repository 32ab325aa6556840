"""Scoring queries: gates, rules, floors, fusion, scenarios, completeness. Subjects are customers, their years are order years."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import rules
from tidemark.plans.market import LISTINGS, listings, r6
from tidemark.plans.registry import registry
from tidemark.sources import table

QUERIES, ORACLE, query = registry()

YEARS = """years AS (SELECT o_custkey AS id, year(o_orderdate)::VARCHAR AS period, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END), 2) AS net,
  round(sum(CASE WHEN o_orderpriority < '3' THEN o_totalprice ELSE -o_totalprice END), 2) AS cash, count(*) AS evidence FROM orders GROUP BY 1, 2)"""
FLAGS = f"""{YEARS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY period DESC) AS n FROM years),
  p AS (SELECT id, max(net) FILTER (n = 1) AS latest, bool_and(net < 0) FILTER (n <= 3) AS all_loss, count(*) FILTER (n <= 3) AS k, bool_and(cash < 0) FILTER (n <= 2) AS cash_out,
    max(net) FILTER (n = 1) - max(net) FILTER (n = 2) AS diff, sum(evidence) AS evidence, max(-cash) FILTER (n = 1) AS burn FROM r GROUP BY 1),
  flags AS (SELECT id, latest < 0 AS latest_loss, k >= 2 AND all_loss AS continuous, (latest < 0 OR (k >= 2 AND all_loss)) AND NOT latest > 0 AS unprofitable,
    cash_out, coalesce(diff < -300000, false) AS margin_drop, evidence, CASE WHEN burn > 0 THEN c_acctbal / (burn / 12) END AS runway FROM p JOIN customer ON c_custkey = id)"""


def yearly(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    net = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    cash = F.when(F.col("o_orderpriority") < "3", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    return o.groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").cast("string").alias("period")).agg(F.round(F.sum(net), 2).alias("net"), F.round(F.sum(cash), 2).alias("cash"), F.count("*").alias("evidence"))


def flags(spark, sf_dir):
    y = yearly(spark, sf_dir)
    w = Window.partitionBy("id").orderBy(F.desc("period"))
    last = y.withColumn("n", F.row_number().over(w)).groupBy("id").agg(
        F.bool_and(F.when(F.col("n") <= 2, F.col("cash") < 0)).alias("cfo_persistently_negative"),
        (F.max(F.when(F.col("n") == 1, F.col("net"))) - F.max(F.when(F.col("n") == 2, F.col("net"))) < -300000).alias("gp_margin_drop_gt_5pp"),
        F.sum("evidence").alias("evidence"),
        F.max(F.when(F.col("n") == 1, -F.col("cash"))).alias("burn"),
    )
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    out = rules.profitability(y, "id", "period", "net").join(last, "id").join(c, "id").withColumn("runway", F.when(F.col("burn") > 0, F.col("c_acctbal") / (F.col("burn") / 12)))
    return out.withColumns({"runway_lt_12": F.col("runway") < 12, "runway_12_24": (F.col("runway") >= 12) & (F.col("runway") < 24), "unprofitable": F.col("is_unprofitable")})


@query(f"""WITH {FLAGS} SELECT id, latest_loss AS latest_full_year_loss, continuous AS continuous_net_loss, unprofitable AS is_unprofitable,
  CASE WHEN unprofitable THEN 'unprofitable' ELSE 'profitable' END AS status FROM flags""")
def profitability_gates(spark, sf_dir):
    """Losses of the last three full years."""
    return rules.profitability(yearly(spark, sf_dir), "id", "period", "net").select("id", "latest_full_year_loss", "continuous_net_loss", "is_unprofitable", "status")


NAMES = ["continuous_net_loss", "latest_full_year_loss", "cfo_persistently_negative", "gp_margin_drop_gt_5pp", "runway_lt_12", "runway_12_24"]
SCORED = f"""{FLAGS}, hits AS (SELECT id, 'CONTINUOUS_LOSS' AS code, 25.0 AS delta FROM flags WHERE continuous UNION ALL SELECT id, 'SINGLE_YEAR_LOSS', 15.0 FROM flags WHERE latest_loss AND NOT continuous
  UNION ALL SELECT id, 'CFO_NEGATIVE', 15.0 FROM flags WHERE cash_out UNION ALL SELECT id, 'GP_MARGIN_DROP', 10.0 FROM flags WHERE margin_drop
  UNION ALL SELECT id, 'CASH_RUNWAY_LT_12', 20.0 FROM flags WHERE runway < 12 AND unprofitable UNION ALL SELECT id, 'CASH_RUNWAY_12_24', 10.0 FROM flags WHERE runway >= 12 AND runway < 24 AND unprofitable),
  scored AS (SELECT f.id, least(100, coalesce(sum(delta), 0))::DOUBLE AS risk_score, coalesce(string_agg(code, ',' ORDER BY code), '') AS codes FROM flags f LEFT JOIN hits h ON h.id = f.id GROUP BY 1)"""
LEVEL = "CASE WHEN {0} < 20 THEN 'very_low' WHEN {0} < 40 THEN 'low' WHEN {0} < 60 THEN 'medium' WHEN {0} < 80 THEN 'high' ELSE 'very_high' END"


def scored(spark, sf_dir):
    f = flags(spark, sf_dir)
    hits = rules.fired(f, "id", NAMES, rules.rule_table(spark, rules.FINANCE_RULES), gates=["unprofitable"], evidence="evidence")
    return rules.scored(f, "id", hits)


@query(f"WITH {SCORED} SELECT id, risk_score, {LEVEL.format('risk_score')} AS risk_level, codes FROM scored")
def rule_scoring(spark, sf_dir):
    """Rules joined to flags, gated, the single-year loss silenced by the continuous one."""
    return scored(spark, sf_dir)


TEXT_FLAGS = """tf AS (SELECT doc_id AS id, regexp_matches(lower(text), 'license') AS redemption_high, false AS redemption_medium, regexp_matches(lower(text), 'rights reserved') AS related_party_rising,
  regexp_matches(lower(text), 'licen|rights') AS exists_redemption, regexp_matches(lower(text), 'rights') AS exists_related_party, regexp_matches(text, '[0-9]') AS exists_pipeline, regexp_matches(text, '[0-9]{4}') AS pipeline_high, lang = 'en' AS biotech FROM documents)"""


@query(f"""WITH {TEXT_FLAGS}, hits AS (SELECT id, 'REDEMPTION_HIGH' AS code, 25.0 AS delta FROM tf WHERE redemption_high UNION ALL SELECT id, 'RELATED_PARTY_TREND', 10.0 FROM tf WHERE related_party_rising
    UNION ALL SELECT id, 'PIPELINE_HIGH', 20.0 FROM tf WHERE pipeline_high AND biotech),
  floors AS (SELECT id, 'EXISTS_REDEMPTION' AS code, 18.0 AS delta FROM tf WHERE exists_redemption AND NOT redemption_high UNION ALL SELECT id, 'EXISTS_RELATED_PARTY', 15.0 FROM tf WHERE exists_related_party
    UNION ALL SELECT id, 'EXISTS_PIPELINE', 12.0 FROM tf WHERE exists_pipeline AND NOT (pipeline_high AND biotech)),
  a AS (SELECT * FROM hits UNION ALL SELECT * FROM floors), s AS (SELECT tf.id, least(100, coalesce(sum(delta), 0))::DOUBLE AS risk_score, coalesce(string_agg(code, ',' ORDER BY code), '') AS codes FROM tf LEFT JOIN a ON a.id = tf.id GROUP BY 1)
  SELECT id, risk_score, {LEVEL.format('risk_score')} AS risk_level, codes FROM s""")
def legal_scoring(spark, sf_dir):
    """Rules and disclosure floors; a floor counts only if no rule of its theme fired."""
    t = F.lower("text")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), t.rlike("license").alias("redemption_high"), F.lit(False).alias("redemption_medium"), t.rlike("rights reserved").alias("related_party_rising"), t.rlike("licen|rights").alias("exists_redemption"), t.rlike("rights").alias("exists_related_party"), F.col("text").rlike("[0-9]").alias("exists_pipeline"), F.col("text").rlike("[0-9]{4}").alias("pipeline_high"), (F.col("lang") == "en").alias("biotech"), F.lit(False).alias("exists_concentration_disclosure"))
    hits = rules.fired(d, "id", ["redemption_high", "redemption_medium", "related_party_rising", "pipeline_high"], rules.rule_table(spark, rules.LEGAL_RULES), gates=["biotech"])
    return rules.scored(d, "id", hits.unionByName(rules.disclosure_floors(d, "id", hits)))


@query(f"""WITH {SCORED}, x AS (SELECT id, least(100, 0.45 * least(100, len(codes) * 2) + 0.55 * risk_score)::DOUBLE AS fundamental, greatest(0, least(100, 50 + c_acctbal / 200))::DOUBLE AS sentiment FROM scored JOIN customer ON c_custkey = id),
  y AS (SELECT *, greatest(0, least(100, 0.65 * fundamental + 0.35 * (100 - sentiment))) AS overall FROM x)
  SELECT id, round(fundamental, 9) AS fundamental, round(100 - sentiment, 9) AS sentiment_risk, round(overall, 9) AS overall_score, {LEVEL.format('overall')} AS overall_level FROM y""")
def fused_risk(spark, sf_dir):
    """Fundamental and inverted sentiment, weighted and clamped."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    x = scored(spark, sf_dir).join(c, "id").withColumn("fundamental", rules.fundamental_score(F.least(F.lit(100.0), F.length("codes") * 2.0), F.col("risk_score"))).withColumn("sentiment", rules.clamp(50 + F.col("c_acctbal") / 200))
    overall = rules.fused_score(F.col("fundamental"), F.col("sentiment"))
    return x.select("id", F.round("fundamental", 9).alias("fundamental"), F.round(100 - F.col("sentiment"), 9).alias("sentiment_risk"), F.round(overall, 9).alias("overall_score"), rules.level(overall).alias("overall_level"))


@query("""WITH o AS (SELECT o_custkey AS id, round(sum(o_totalprice), 2) AS outflow, count(DISTINCT date_trunc('month', o_orderdate)) AS months FROM orders GROUP BY 1)
  SELECT id, scenario, round(outflow * factor / greatest(months, 1), 8) AS monthly_burn, CASE WHEN outflow > 0 THEN round(c_acctbal / (outflow * factor / greatest(months, 1)), 8) + 0 END AS runway_months, outflow > 0 AS sensitive
  FROM o JOIN customer ON c_custkey = id, (VALUES ('optimistic', 0.7::DOUBLE), ('neutral', 1.0::DOUBLE), ('pessimistic', 1.5::DOUBLE)) s(scenario, factor)""")
def burn_sensitivity(spark, sf_dir):
    """Three scenarios of the burn rate. No burn: null runway."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.round(F.sum("o_totalprice"), 2).alias("outflow"), F.countDistinct(F.trunc("o_orderdate", "month")).alias("months"))
    rows = o.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal"), "id")
    return rules.burn_scenarios(rows, "outflow", "months", "c_acctbal", 8).select("id", "scenario", "monthly_burn", "runway_months", "sensitive")


@query(f"""WITH {LISTINGS}, g AS (SELECT o_custkey, segment, [CASE WHEN return_1 IS NULL THEN 'return_1' END, CASE WHEN base_value < 50000 THEN 'base' END] AS hard,
    [CASE WHEN return_5 IS NULL THEN 'return_5' END, CASE WHEN return_20 IS NULL THEN 'return_20' END, CASE WHEN segment = 'FURNITURE' THEN 'segment' END] AS soft FROM listings),
  n AS (SELECT *, list_filter(hard, lambda x: x IS NOT NULL) AS h, list_filter(soft, lambda x: x IS NOT NULL) AS s FROM g)
  SELECT o_custkey, array_to_string(h, ';') AS hard_gaps, array_to_string(s, ';') AS soft_gaps, CASE WHEN len(h) > 0 THEN 'core_gap' WHEN len(s) = 0 THEN 'strict' ELSE 'usable' END AS tier,
    (100 - 6 * len(h) - 2 * len(s) + CASE WHEN segment <> 'FURNITURE' THEN 5 ELSE 0 END)::BIGINT AS score FROM n""")
def completeness_tier(spark, sf_dir):
    """Gap lists, tier, and score: 6 off for a hard gap, 2 for a soft one, 5 more for a known segment."""
    x = listings(spark, sf_dir)
    g = x.withColumns(rules.gaps([(F.col("return_1").isNull(), "return_1"), (F.col("base_value") < 50000, "base")], [(F.col("return_5").isNull(), "return_5"), (F.col("return_20").isNull(), "return_20"), (F.col("segment") == "FURNITURE", "segment")]))
    tier = F.when(F.col("n_hard") > 0, "core_gap").when(F.col("n_soft") == 0, "strict").otherwise("usable")
    score = 100 - 6 * F.col("n_hard") - 2 * F.col("n_soft") + F.when(F.col("segment") != "FURNITURE", 5).otherwise(0)
    return g.select("o_custkey", "hard_gaps", "soft_gaps", tier.alias("tier"), score.cast("long").alias("score"))


@query("""WITH g AS (SELECT c_mktsegment, count(*) AS peers, avg(c_acctbal) AS mean, median(c_acctbal) AS median, stddev_samp(c_acctbal) AS sd FROM customer GROUP BY 1)
  SELECT c_custkey, c_mktsegment, peers, round(mean, 4) AS mean, round(median, 4) AS median, round(coalesce((c_acctbal - mean) / nullif(sd, 0), 0), 6) AS z, coalesce(abs((c_acctbal - mean) / nullif(sd, 0)) > 2, false) AS outlier, peers < 3 AS limited
  FROM customer JOIN g USING (c_mktsegment)""")
def peer_zscore(spark, sf_dir):
    """One aggregation per group, joined back; no window gathers a group."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return rules.peer_zscore(c, "c_mktsegment", "c_acctbal").select("c_custkey", "c_mktsegment", "peers", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), r6(F.col("z"), "z"), "outlier", "limited")


@query(f"""WITH {SCORED}, tall AS (SELECT id, unnest(string_split(codes, ',')) AS code, 'rule' AS source FROM scored WHERE codes <> ''),
  m AS (SELECT id, CASE WHEN code LIKE '%LOSS%' THEN 'LOSS' WHEN code LIKE 'CASH%' THEN 'CASH' ELSE code END AS code, length(code)::DOUBLE AS delta, source FROM tall UNION ALL SELECT id, 'LOSS', 16.0, 'model' FROM scored WHERE id % 2 = 0)
  SELECT id, code, max(delta) AS delta, CASE WHEN max(delta) FILTER (source = 'model') = max(delta) THEN 'model' ELSE 'rule' END AS source FROM m GROUP BY 1, 2""")
def rule_floor_merge(spark, sf_dir):
    """Rules and model findings by canonical code, the larger delta wins, ties go to the model."""
    s = scored(spark, sf_dir)
    found = s.where("codes <> ''").select("id", F.explode(F.split("codes", ",")).alias("code")).select("id", "code", F.length("code").cast("double").alias("delta"), F.lit("rule").alias("source"))
    model = s.where("id % 2 = 0").select("id", F.lit("LOSS").alias("code"), F.lit(16.0).alias("delta"), F.lit("model").alias("source"))
    canonical = rules.first_match([(F.col("code").contains("LOSS"), "LOSS"), (F.col("code").startswith("CASH"), "CASH")], "")
    return rules.keep_strongest(found.unionByName(model), "id", F.when(canonical == "", F.col("code")).otherwise(canonical))
