"""Findings of themes in passages: which passages speak of a theme, the numbers that belong to its cues, and the passages as evidence.

A passage meets all themes in one pass. A theme has cues that make a passage relevant, cues that make it strong or only weak, noise that
rules it out unless it is strong, and alarms. Numbers count where they stand: those of a cue lie within a window of characters after
it, which ends where another cue begins. What is kept of a document's theme is a bounded number of passages, by rank.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Theme:
    name: str
    codes: Sequence[str]
    cues: Sequence[str]
    strong: Sequence[str]
    noise: Sequence[str] = ()
    weak: Sequence[str] = ()
    alarms: Sequence[str] = ()
    #: Condition on ``text`` under which it is strong without a cue.
    also: str = "false"


#: Characters after a cue that its numbers lie in; passages kept, and shown as evidence; characters of an excerpt.
WINDOW, KEPT, SHOWN, EXCERPT = 260, 15, 5, 200
_PERCENT = r"(\d+(?:\.\d+)?)\s*%"
#: Words of those who sell to and buy from a company, by the metric they belong to.
SUPPLIERS, CUSTOMERS = ("供應商", "供应商"), ("客戶", "客户")
#: Where the numbers of one cue end.
BOUNDARIES = ("同期", "最大供應商", "最大供应商", "最大客戶", "最大客户")
#: Cues of the largest and the five largest customers and suppliers.
SHARES = {
    "top1_customer": ("最大客户", "最大客戶", "单一客户", "單一客戶"),
    "top5_customer": ("前五大客戶", "前五大客户", "五大客戶", "五大客户"),
    "top1_supplier": ("最大供應商", "最大供应商"),
    "top5_supplier": ("前五大供應商", "前五大供应商"),
}
#: Stages of trials and the marks that tell them.
STAGES = {"III期": r"(?i)III\s*期|三期|第III期", "II期": r"(?i)II\s*期|二期|第II期", "I期": r"(?i)I\s*期|一期|第I期", "注册申请": "(?i)NDA|BLA|上市申請|上市申请"}
#: The words of each theme.
THEMES = (
    Theme(
        "redemption", ("REDEMPTION_CLAUSE", "gamble_redemption"),
        ("赎回", "贖回", "对赌", "對賭", "回购", "回購", "优先股", "優先股", "领售", "領售", "撤资", "撤資", "贖回權", "可換股", "可转换可赎回", "可轉換可贖回", "股东协议", "股東協議", "特别权利", "特別權利", "赎回权终止", "特別權利終止"),
        ("對賭", "对赌", "優先股", "优先股", "贖回權", "赎回权", "要求公司贖回", "要求公司赎回", "有權要求", "有权要求", "撤資權益", "撤资权益", "領售", "领售", "回購義務", "回购义务", "可轉換可贖回", "可转换可赎回", "特別權利", "特别权利"),
        noise=("理財產品", "理财产品", "到期及贖回", "到期及赎回", "購回股份的一般授權"),
    ),
    Theme(
        "related_party", ("RELATED_PARTY", "related_party"),
        ("關連交易", "关联交易", "持續關連", "持续关连", "關連交易豁免", "关联交易豁免", "非豁免關連", "关联方", "關連方", "核心關連"),
        ("關連交易", "关联交易", "持續關連", "持续关连", "關連交易豁免", "关联交易豁免", "非豁免關連"),
        noise=("購回股份的一般授權", "购回股份的一般授权", "知會本公司", "知会本公司", "目前有意在購回", "目前有意在购回", "承諾向本公司出售股份"), weak=("關連", "关联"),
    ),
    Theme(
        "concentration", ("CONCENTRATION", "concentration", "customer"),
        ("前五大客户", "五大客戶", "最大客户", "最大客戶", "前五大供應商", "前五大供应商", "佔總收入", "占总收入", "佔總採購", "占总采购", *SUPPLIERS, *CUSTOMERS),
        ("前五大客户", "五大客戶", "最大客户", "最大客戶", "前五大供應商", "前五大供应商", "佔總收入", "占总收入", "佔總採購", "占总采购"),
        also=r"text RLIKE '供應商|供应商|客戶|客户' AND text RLIKE '(?i)%|比例|供應商A|供应商A|\\d+\\.\\d+\\s*</td>\\s*</tr>'",
    ),
    Theme(
        "pipeline", ("PIPELINE_RISK", "PIPELINE", "pipeline"),
        ("核心產品", "核心产品", "臨床試驗", "临床试验", "臨床擱置", "临床搁置", "暫停臨床", "暂停临床", "管線", "管线", "授權引進", "授权引进", "license-in", "知識產權", "知识产权", "NDA", "BLA", "監管批准", "监管批准"),
        ("核心產品", "核心产品", "臨床試驗", "临床试验", "管線候選", "管线候选", "產品管線", "产品管线", "授權引進", "授权引进", "臨床研究", "临床研究"),
        alarms=("臨床擱置", "临床搁置", "暫停臨床", "暂停临床", "终止开发", "終止開發", "临床失败", "臨床失敗", "研发失败", "研發失敗"),
    ),
)


def has_any(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)) if words else F.lit(False)


def _numbers(text: Column, pattern: str, group: int = 1) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda n: n.cast("double"))


def shares(text: Column) -> Column:
    """Percentages of a passage: those with a sign and, where suppliers or customers are named, the last cells of rows of numbers.

    Without any, where these are named the last cells of rows, then cells beside the word for a share, then numbers after it.
    """
    real = lambda a: F.filter(a, lambda v: (v > 0) & (v <= 100))
    parties = has_any(text, [*SUPPLIERS, *CUSTOMERS])
    none = F.array().cast("array<double>")
    signed = F.concat(_numbers(text, _PERCENT), F.when(parties, real(_numbers(text, r"(?i)<td[^>]*>\s*([\d,]+(?:\.\d+)?)\s*</td>\s*<td[^>]*>\s*(\d+(?:\.\d+)?)\s*</td>\s*</tr>", 2))).otherwise(none))
    ways = [
        signed,
        F.when(parties, real(_numbers(text, r"(?i)<td[^>]*>\s*(\d+(?:\.\d+)?)\s*</td>\s*</tr>"))).otherwise(none),
        F.when(F.contains(text, F.lit("比例")), real(_numbers(text, r">\s*(\d+(?:\.\d+)?)\s*<"))).otherwise(none),
        real(_numbers(text, r"(?:比例|%)[^\d]{0,8}(\d+(?:\.\d+)?)")),
    ]
    return F.coalesce(*(F.when(F.size(w) > 0, w) for w in ways), none)


def scoped(text: Column, cues: Sequence[str], boundaries: Sequence[str] = BOUNDARIES, window: int = WINDOW) -> Column:
    """Percentages within ``window`` characters from the first of the cues, up to the first of ``boundaries`` (in their order) that follows; null without a cue."""
    places = [F.when(F.instr(text, c) > 0, F.instr(text, c)) for c in cues]
    at = F.least(*places) if len(places) > 1 else places[0]
    segment = F.substring(text, at, F.lit(window))
    cut = F.coalesce(*(F.when(F.locate(b, segment, 3) > 0, F.substring(segment, F.lit(1), F.locate(b, segment, 3) - 1)) for b in boundaries), segment)
    return F.when(at.isNotNull(), _numbers(cut, _PERCENT))


def passages(hits: DataFrame, key: str, themes: Sequence[Theme] = THEMES, code_col: str = "code", text_col: str = "text", order: Sequence[str] = ("rank",)) -> DataFrame:
    """The rows of ``hits`` that are relevant to a theme, once for each: theme, grade (2 strong, 1 weak, 0 neither), alarm, shares, place beside key, code, text and ``order``.

    A passage is relevant to a theme by its field code or a cue; noise without a strong cue takes it out (grade -1). place: from 1, strong
    ones first, alarms and then many shares before, as the theme ranks them. Null texts are relevant to nothing.
    """
    own = hits.select(F.col(key), F.col(code_col).alias("code"), F.col(text_col).alias("text"), *order).where("text IS NOT NULL")
    t = F.col("text")
    judged = []
    for theme in themes:
        strong = has_any(t, theme.strong) | has_any(t, theme.alarms) | F.expr(theme.also)
        grade = F.when(has_any(t, theme.noise) & ~strong, -1).when(strong, 2).when(has_any(t, theme.weak), 1).otherwise(0)
        judged.append(F.when(F.col("code").isin(*theme.codes) | has_any(t, theme.cues), F.struct(F.lit(theme.name).alias("theme"), grade.alias("grade"), has_any(t, theme.alarms).alias("alarm"))))
    own = own.withColumn("_j", F.explode(F.filter(F.array(*judged), lambda j: j.isNotNull()))).select(key, "code", "text", *order, "_j.*").withColumn("shares", shares(t))
    rich = F.when(F.col("theme") == "concentration", F.when(has_any(t, ["供應商A", "供应商A"]), 5).otherwise(0) + F.size("shares")).otherwise(0)
    return own.withColumn("place", F.row_number().over(Window.partitionBy(key, "theme").orderBy(F.desc("grade"), F.desc(F.when(F.col("theme") == "pipeline", F.col("alarm")).otherwise(False)), F.desc(rich), *order, "text")))


def findings(hits: DataFrame, key: str, page_col: str = "page", themes: Sequence[Theme] = THEMES, code_col: str = "code", text_col: str = "text", rank_col: str = "rank") -> DataFrame:
    """One row per key and theme with relevant passages.

    found: strong passages, or weak ones where there is none of those; n_relevant, n_noise, n_found; alarm: a passage has an alarm; ratio:
    the largest share of related parties; rate, months: those of a redemption clause; top1_customer, top5_customer, top1_supplier,
    top5_supplier: shares by their cues, else by the table of shares; stages: those of trials that are named; high: the theme's
    own limit is passed (months below 12, ratio over 30, a share over 50, an alarm); evidence: pages and excerpts of the first five;
    strength. Only the first 15 passages of a key and theme give numbers.
    """
    placed = passages(hits.withColumn("_page", F.col(page_col)), key, themes, code_col, text_col, (rank_col, "_page"))
    t = F.col("text")
    near = {name: scoped(t, cues) for name, cues in SHARES.items()}
    first = lambda name: F.when(F.size("shares") > 0, F.coalesce(F.array_max(near[name]), F.get("shares", F.lit(0)) if name == "top1_customer" else F.array_max("shares")))
    values = [F.when(has_any(t, cues), F.nullif(first(name), F.lit(0.0))).alias(name) for name, cues in SHARES.items()]
    supplier, customer = has_any(t, [*SUPPLIERS, "採購", "采购"]), has_any(t, [*CUSTOMERS, "收入"])
    none = F.array().cast("array<double>")
    facts = F.struct(
        "place", "grade", "alarm", "shares", F.col("_page").alias("page"), F.substring(t, 1, 400).alias("start"), *values,
        F.when(supplier, F.col("shares")).otherwise(none).alias("of_suppliers"), F.when(customer, F.col("shares")).otherwise(none).alias("of_customers"),
    )
    # No more than KEPT passages of a group are gathered; the counts are sums.
    kept = F.sort_array(F.collect_list(F.when((F.col("place") <= KEPT) & (F.col("grade") > 0), facts)))
    g = placed.groupBy(key, "theme").agg(
        kept.alias("kept"), F.count("*").alias("n_relevant"), F.count_if(F.col("grade") == -1).alias("n_noise"), F.count_if(F.col("grade") == 2).alias("n_strong"), F.count_if(F.col("grade") == 1).alias("n_weak"),
        F.coalesce(F.bool_or(F.col("alarm") & (F.col("grade") == 2)), F.lit(False)).alias("alarm"),
    )
    g = g.withColumn("n_found", F.when(F.col("n_strong") > 0, F.col("n_strong")).otherwise(F.col("n_weak")))
    g = g.withColumn("kept", F.filter("kept", lambda h: h["grade"] == F.when(F.col("n_strong") > 0, 2).otherwise(1)))
    is_ = lambda name: F.col("theme") == name
    joined = lambda n, chars: F.array_join(F.transform(F.slice("kept", 1, n), lambda h: F.substring(h["start"], 1, chars)), " ")
    either = lambda text, pattern, kind: F.coalesce(*(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast(kind) for k in (1, 2)))
    every = lambda c: F.flatten(F.transform("kept", lambda h: h[c]))
    by_cue = lambda c: F.get(F.filter(F.transform("kept", lambda h: h[c]), lambda v: v.isNotNull()), F.lit(0))
    g = g.withColumns({
        "ratio": F.when(is_("related_party"), F.array_max(F.flatten(F.transform(F.slice("kept", 1, 10), lambda h: h["shares"])))),
        "rate": F.when(is_("redemption"), either(joined(SHOWN, 300), r"年[化利率息]\s*(\d+(?:\.\d+)?)\s*%|年利率\s*(\d+(?:\.\d+)?)\s*%", "double")),
        "months": F.when(is_("redemption"), either(joined(SHOWN, 300), r"(\d+)\s*个?月内|於\s*(\d+)\s*個月", "int")),
        "stages": F.when(is_("pipeline"), F.filter(F.array(*(F.when(joined(8, 400).rlike(p), F.lit(s)) for s, p in STAGES.items())), lambda s: s.isNotNull())),
        "_s": every("of_suppliers"), "_c": every("of_customers"), **{name: F.when(is_("concentration"), by_cue(name)) for name in SHARES},
    })
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    g = g.withColumns({f"top1_{p}": F.when(is_("concentration"), F.coalesce(f"top1_{p}", F.array_max(c))) for p, c in (("supplier", "_s"), ("customer", "_c"))})
    g = g.withColumns({
        "top5_supplier": F.when(is_("concentration") & (F.size("_s") > 0), F.coalesce("top5_supplier", F.when(total("_s") <= 100, F.round(total("_s"), 2)).otherwise(F.col("top1_supplier")))).otherwise(F.col("top5_supplier")),
        "top5_customer": F.when(is_("concentration") & (F.size("_c") > 0), F.coalesce("top5_customer", F.when(total("_c") <= 100, F.round(total("_c"), 2)).otherwise(F.array_max("_c")))).otherwise(F.col("top5_customer")),
    })
    flag = lambda c: F.coalesce(c, F.lit(False))
    high = flag(F.when(is_("redemption"), F.col("months") < 12).when(is_("related_party"), F.col("ratio") > 30).when(is_("concentration"), F.greatest(*SHARES) > 50).otherwise(F.col("alarm")))
    two = (F.col("n_found") >= 2) & (~is_("related_party") | (F.col("n_strong") > 0)) | (is_("pipeline") & F.col("alarm"))
    evidence = F.transform(F.slice("kept", 1, SHOWN), lambda h: F.struct(h["page"].alias("page"), F.substring(F.translate(h["start"], "\n", " "), 1, EXCERPT).alias("excerpt")))
    return g.select(
        key, "theme", (F.col("n_found") > 0).alias("found"), "n_relevant", "n_noise", "n_found", (F.col("alarm") & is_("pipeline")).alias("alarm"), "ratio", "rate", "months", *SHARES, "stages", high.alias("high"),
        F.when(two, "high").when(F.col("n_found") > 0, "medium").otherwise("low").alias("strength"), evidence.alias("evidence"),
    )


def assembled(sections: DataFrame, section_col: str, sources: Mapping[str, tuple[DataFrame, int]], key: str, order: Sequence[str]) -> DataFrame:
    """Evidence of every section of every key: from the first of ``sources`` that has any, no more rows than its quota, else a placeholder.

    ``sections``: key, section and ``skipped`` (why it is left out, or null). ``sources``: name to rows (key, section, ``order``, text) and quota, in
    order of preference. Gives key, section, source (``skipped`` and ``absent`` for placeholders), position from 1, text.
    """
    every = None
    for n, (name, (df, quota)) in enumerate(sources.items()):
        one = df.withColumn("position", F.row_number().over(Window.partitionBy(key, section_col).orderBy(*order, "text"))).where(F.col("position") <= quota)
        one = one.select(key, section_col, F.lit(n).alias("_n"), F.lit(name).alias("source"), "position", "text")
        every = one if every is None else every.union(one)
    wanted = sections.select(key, section_col, "skipped")
    # The quotas bound what a section has here, so that this window sees some dozens of rows.
    met = wanted.join(every, [key, section_col], "left").withColumn("_first", F.min("_n").over(Window.partitionBy(key, section_col)))
    met = met.where(F.col("_n").eqNullSafe(F.col("_first")))
    gone = F.col("skipped").isNotNull()
    out = met.where(~gone | (F.coalesce("position", F.lit(1)) == 1))
    return out.select(key, section_col, F.when(gone, "skipped").otherwise(F.coalesce("source", F.lit("absent"))).alias("source"), F.when(gone, 1).otherwise(F.coalesce("position", F.lit(1))).alias("position"), F.when(gone, F.col("skipped")).otherwise(F.coalesce("text", F.lit("no evidence"))).alias("text"))
