"""Gates: each a struct(gate, kind, result, detail); a candidate passes if no absolute gate fails."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ABSOLUTE = ("registration", "affordability", "segment", "profile", "pathway", "age_band")


@dataclass(frozen=True)
class Brief:
    """Thresholds of one search. None means no limit."""

    segment: str
    budget_fee: float | None = None
    budget_wage: float | None = None
    contract_years: int = 3
    age_min: float | None = None
    age_max: float | None = None
    age_leeway: float = 2.0
    wage_band: float | None = None
    proposed_wage: float | None = None
    min_height: float | None = None
    min_share: float | None = None
    min_rows: int = 5
    older_age: float = 30.0
    risk_limit: float = 0.40
    projection_floor: float = 40.0
    projection_needed: bool = False
    pathway_months: float | None = None
    pathway_age: float | None = None
    wage_multiple: float = 1.2
    gates: tuple[str, ...] = field(default=())


def gate(name: str, result: Column, detail: str) -> Column:
    kind = "absolute" if name in ABSOLUTE else "conditional"
    return F.struct(F.lit(name).alias("gate"), F.lit(kind).alias("kind"), result.alias("result"), F.lit(detail).alias("detail"))


def affordability(b: Brief) -> Column:
    """Fee against its cap, wages over the contract against theirs; with both, the sum against the sum of caps."""
    fee, wage = F.col("value"), F.col("wage")
    if b.budget_fee is None and b.budget_wage is None:
        return F.lit("pass")
    if b.budget_wage is None:
        cost, cap = fee, b.budget_fee
    elif b.budget_fee is None:
        cost, cap = wage, b.budget_wage
    else:
        cost, cap = fee + wage * b.contract_years, b.budget_fee + b.budget_wage * b.contract_years
    return F.when(cost <= cap, "pass").otherwise("fail")


def age_band(b: Brief) -> Column:
    """Inside the band passes, within the leeway is a caution, outside or unknown fails."""
    age = F.col("age")
    low, high = b.age_min if b.age_min is not None else 0.0, b.age_max if b.age_max is not None else 99.0
    return F.when(age.isNull(), "fail").when(age.between(low, high), "pass").when(age.between(low - b.age_leeway, high + b.age_leeway), "caution").otherwise("fail")


def profile(b: Brief) -> Column:
    """Height below the floor or a share below its least (from min_rows rows on) fails; too few rows are a caution."""
    low = F.lit(False) if b.min_height is None else F.coalesce(F.col("height") < b.min_height, F.lit(False))
    if b.min_share is None:
        return F.when(low, "fail").otherwise("pass")
    enough = F.coalesce(F.col("label_rows") >= b.min_rows, F.lit(False))
    short = enough & F.coalesce(F.col("label_share") < b.min_share, F.lit(False))
    return F.when(low | short, "fail").when(~enough, "caution").otherwise("pass")


def pathway(b: Brief) -> tuple[Column, Column]:
    """Hard: an internal option under a year away blocks no older candidate on more than two years. Soft: one to two
    years away and a longer contract is an exception."""
    months = b.pathway_months
    if months is None:
        return F.lit("pass"), F.lit("pass")
    long_contract = b.contract_years > 2
    same_age = F.coalesce(F.col("age") <= b.pathway_age, F.lit(False)) if b.pathway_age is not None else F.lit(False)
    hard = F.when(F.lit(months < 12 and long_contract) & same_age, "fail").otherwise("pass")
    return hard, F.lit("exception" if 12 <= months <= 24 and long_contract else "pass")


def evaluate(context: DataFrame, b: Brief) -> DataFrame:
    """context plus gates (array of structs), passed and the names of cautions and exceptions.

    Needs: status, value, wage, segments (array), age, risk, confidence_tier, projection; height, label_rows and
    label_share where the brief asks for them.
    """
    hard, soft = pathway(b)
    discipline = F.lit("pass") if b.wage_band is None else F.when(F.coalesce(F.lit(b.proposed_wage).cast("double"), F.col("wage")).isNull(), "caution").when(F.coalesce(F.lit(b.proposed_wage).cast("double"), F.col("wage")) > b.wage_multiple * b.wage_band, "caution").otherwise("pass")
    projection = F.lit("pass") if not b.projection_needed else F.when(F.coalesce(F.col("projection") >= b.projection_floor, F.lit(False)), "pass").otherwise("exception")
    every = [
        gate("registration", F.when(F.col("status") == "red", "fail").otherwise("pass"), "registration status"),
        gate("affordability", affordability(b), "fee and wages against their caps"),
        gate("segment", F.when(F.coalesce(F.array_contains("segments", F.lit(b.segment)), F.lit(False)), "pass").otherwise("fail"), "segment of the brief"),
        gate("profile", profile(b), "height and shares"),
        gate("pathway", hard, "internal option within a year"),
        gate("age_band", age_band(b), "age band"),
        gate("wage_discipline", discipline, "wage against the band"),
        gate("age_profile", F.when(F.col("age") > b.older_age, "caution").otherwise("pass"), "older signing"),
        gate("availability", F.when(F.coalesce(F.col("risk") <= b.risk_limit, F.lit(False)), "pass").otherwise("caution"), "risk of absence"),
        gate("confidence", F.when(F.coalesce(F.col("confidence_tier").isin("very_low", "low"), F.lit(True)), "caution").otherwise("pass"), "sample size"),
        gate("projection", projection, "projected level"),
        gate("pathway_soft", soft, "internal option within two years"),
    ]
    out = context.withColumn("gates", F.array(*every))
    named = lambda result: F.transform(F.filter("gates", lambda g: g["result"] == result), lambda g: g["gate"])
    failed = F.filter("gates", lambda g: (g["kind"] == "absolute") & (g["result"] == "fail"))
    return out.withColumns({"passed": F.size(failed) == 0, "cautions": named("caution"), "exceptions": named("exception")})
