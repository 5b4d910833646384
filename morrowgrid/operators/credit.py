"""Expected credit loss: origination PD, staging, loss, scenarios and sensitivities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expressions import cents, lookup, r6, ratio

# Fixed values of the model: maturity in years by purpose, loss given default by tenure, scenarios (weight, PD factor, LGD shift).
MATURITY = {"AUTOMOBILE": 5, "BUILDING": 7, "FURNITURE": 3, "HOUSEHOLD": 3, "MACHINERY": 4}
LGD = {"OWN": 0.35, "MORTGAGE": 0.4, "RENT": 0.55, "OTHER": 0.5}
SCENARIOS = [("base", 0.5, 1.0, 0.0), ("adverse", 0.3, 1.5, 0.1), ("favourable", 0.2, 0.8, -0.05)]
STAGE3, STAGE2_PD, STAGE2_FACTOR = 0.6, 0.2, 2.0


def orig_pd(book: DataFrame, grade: str = "grade", pd12: str = "pd12") -> DataFrame:
    """Mean 12-month PD of the loan's grade, as a small broadcast table rather than a window over grades."""
    g = book.groupBy(grade).agg(ratio(F.sum(F.col(pd12).cast("decimal(18,6)")), F.count(pd12)).alias("orig_pd"))
    return book.join(F.broadcast(g), grade)


def stage(backstop: float = STAGE2_PD) -> Column:
    pd = F.col("pd12")
    return F.when(pd >= STAGE3, 3).when((pd >= STAGE2_FACTOR * F.col("orig_pd")) | (pd >= backstop), 2).otherwise(1)


def book(loans: DataFrame, backstop: float = STAGE2_PD) -> DataFrame:
    """Loans with exposure, maturity, LGD, effective rate and stage."""
    b = orig_pd(loans)
    return b.withColumns({"ead": F.col("amount"), "maturity": lookup(F.col("intent"), MATURITY), "lgd": lookup(F.col("home"), LGD), "eir": F.coalesce("int_rate", F.lit(10.0)) / 100}).withColumn("stage", stage(backstop))


def ecl(pd_mult: Column, lgd_add: Column) -> Column:
    """Loss of one loan: 12 months in stage 1, else its life, discounted at the effective rate to mid-term."""
    pd = F.least(F.col("pd12") * pd_mult, F.lit(1.0))
    lgd = F.least(F.col("lgd") + lgd_add, F.lit(1.0))
    years = F.col("maturity")
    life = 1 - F.pow(1 - pd, years)
    short = pd * lgd * F.col("ead") * F.pow(1 + F.col("eir"), F.lit(-0.5))
    return F.when(F.col("stage") == 1, short).otherwise(life * lgd * F.col("ead") * F.pow(1 + F.col("eir"), -years / 2))


def loan_ecl(b: DataFrame) -> DataFrame:
    return b.withColumn("ecl", F.round(ecl(F.lit(1.0), F.lit(0.0)), 4))


def stage_table(b: DataFrame) -> DataFrame:
    e = loan_ecl(b)
    g = e.groupBy("stage").agg(F.count("*").alias("n_loans"), F.sum(cents("ead")).alias("e"), ratio(F.sum(F.col("pd12").cast("decimal(18,6)")), F.count("*")).alias("mean_pd"), F.sum(F.col("ecl").cast("decimal(18,4)")).alias("l"))
    t = g.agg(F.sum("e").alias("te"))
    return g.crossJoin(F.broadcast(t)).select("stage", "n_loans", F.col("e").cast("double").alias("ead"), "mean_pd", F.col("l").cast("double").alias("ecl"), ratio(F.col("e"), F.col("te")).alias("ead_share"), ratio(F.col("l"), F.col("e")).alias("coverage"))


def coverage_by(b: DataFrame, key: str) -> DataFrame:
    return loan_ecl(b).groupBy(key).agg(ratio(F.sum(F.col("ecl").cast("decimal(18,4)")), F.sum(cents("ead"))).alias("coverage"), F.count("*").alias("n_loans"))


def _total(c: Column) -> Column:
    return F.sum(F.round(c, 4).cast("decimal(18,4)")).cast("double")


def scenarios(b: DataFrame) -> DataFrame:
    """Total loss in each scenario; the stage stays as it is. One pass over the loans for all scenarios."""
    one = b.agg(*(_total(ecl(F.lit(m), F.lit(a))).alias(n) for n, _, m, a in SCENARIOS))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(w).alias("weight"), F.col(n).alias("ecl")) for n, w, _, _ in SCENARIOS))).alias("s")).select("s.*")


def weighted(b: DataFrame) -> DataFrame:
    s = scenarios(b)
    base = F.max(F.when(F.col("scenario") == "base", F.col("ecl")))
    return s.agg(r6(F.sum(F.col("weight") * F.col("ecl"))).alias("weighted_ecl"), base.alias("base_ecl")).withColumn("uplift", r6(F.col("weighted_ecl") / F.col("base_ecl") - 1))


def sensitivity(loans: DataFrame) -> DataFrame:
    """Loss under six variants of LGD, PD, scenario weights and the staging backstop, with the change from base."""
    b = book(loans)
    one = b.agg(_total(ecl(F.lit(1.0), F.lit(0.0))).alias("base"), _total(ecl(F.lit(1.0), F.lit(0.1))).alias("lgd_up"), _total(ecl(F.lit(1.0), F.lit(-0.1))).alias("lgd_down"), _total(ecl(F.lit(1.2), F.lit(0.0))).alias("pd_up"), _total(ecl(F.lit(0.8), F.lit(0.0))).alias("pd_down"), *(_total(ecl(F.lit(m), F.lit(a))).alias(f"s_{n}") for n, _, m, a in SCENARIOS))
    tight = book(loans, 0.15).agg(_total(ecl(F.lit(1.0), F.lit(0.0))).alias("backstop"))
    w = F.col("s_base") * 0.3 + F.col("s_adverse") * 0.5 + F.col("s_favourable") * 0.2
    j = one.crossJoin(F.broadcast(tight)).withColumn("adverse_weight", w)
    names = ["lgd_up", "lgd_down", "pd_up", "pd_down", "adverse_weight", "backstop"]
    return j.select(F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), F.round(F.col(n), 4).alias("ecl"), F.round(F.col(n) - F.col("base"), 4).alias("delta"), r6(F.col(n) / F.col("base") - 1).alias("delta_pct")) for n in names))).alias("v")).select("v.*")
