"""Credit policy, experiment assignment and record checks as stateless columns.

The same functions serve batch tables and streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from underwrite import config as C
from underwrite.functions.parsing import col, dec
from underwrite.functions.scoring import risk_band

FACTOR_TYPE = "array<struct<feature:string,impact:double>>"


def rule_codes(policy: C.CreditPolicy, income: Column, installment: Column, dti: Column) -> Column:
    """Codes of the knock-out rules a row breaks, model aside."""
    yearly, monthly = F.coalesce(income, dec(0)), F.coalesce(installment, dec(0))
    heavy = (yearly > 0) & (F.try_divide(monthly, yearly / dec(12)) > policy.max_payment_to_income)
    return F.array_compact(
        F.array(
            F.when(heavy, F.lit(C.REASON_PAYMENT)),
            F.when(dti > policy.max_dti, F.lit(C.REASON_DTI)),
        )
    )


def risk_codes(factors: Column) -> Column:
    """Variables that raised the probability, strongest first."""
    raising = F.filter(factors, lambda f: f["impact"] > 0)
    ordered = F.sort_array(F.transform(raising, lambda f: F.struct((-f["impact"]).alias("k"), f["feature"].alias("f"))))
    return F.transform(ordered, lambda f: F.concat(F.lit(C.REASON_PREFIX), F.upper(f["f"])))


def violations(
    p: Column, threshold: Column, band: Column | None = None, model_decision: Column | None = None
) -> Column:
    """Codes of the output invariants a model answer breaks; empty when it may be used."""
    usable = F.coalesce(~F.isnan(p) & p.between(0, 1), F.lit(False))
    checks = [
        F.when(~usable, F.lit("pd_out_of_range")),
        F.when(~F.coalesce((threshold > 0) & (threshold < 1), F.lit(False)), F.lit("threshold_out_of_range")),
    ]
    if band is not None:
        checks.append(F.when(usable & (band != risk_band(p)), F.lit("band_mismatch")))
    if model_decision is not None:
        clear = model_decision.isin(C.APPROVE, C.REJECT)
        disagrees = (model_decision == C.REJECT) != (p >= threshold)
        checks.append(F.when(usable & clear & disagrees, F.lit("decision_mismatch")))
    return F.array_compact(F.array(*checks))


def decide(
    p: Column | str,
    threshold: Column | str,
    income: Column | str,
    installment: Column | str,
    dti: Column | str,
    factors: Column | None = None,
    broken: Column | None = None,
    policy: C.CreditPolicy | None = None,
) -> Column:
    """Struct (decision, reasons, policy_version).

    A missing or incoherent probability never approves: it goes to manual review with its
    reason. Then knock-out rules, then the threshold, then the grey zone below it.
    """
    policy = policy or C.CreditPolicy()
    prob, cut = col(p), col(threshold)
    rules = rule_codes(policy, col(income), col(installment), col(dti))
    extra = risk_codes(factors) if factors is not None else F.array().cast("array<string>")
    bad = F.size(broken if broken is not None else violations(prob, cut)) > 0
    knocked = F.size(rules) > 0

    def coded(head: Column) -> Column:
        return F.slice(F.concat(head, extra), 1, policy.max_reason_codes)

    def one(code: str) -> Column:
        return F.array(F.lit(code))

    grey = prob >= cut - dec(policy.review_band)
    decision = (
        F.when(prob.isNull() | bad, C.REVIEW)
        .when(knocked | (prob >= cut), C.REJECT)
        .when(grey, C.REVIEW)
        .otherwise(C.APPROVE)
    )
    reasons = (
        F.when(prob.isNull(), one(C.REASON_NO_MODEL))
        .when(bad, one(C.REASON_BROKEN))
        .when(knocked, coded(rules))
        .when(prob >= cut, coded(one(C.REASON_PD_HIGH)))
        .when(grey, coded(one(C.REASON_GREY_ZONE)))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.struct(
        decision.alias("decision"), reasons.alias("reasons"), F.lit(policy.version).alias("policy_version")
    )


def traffic_bucket(id_: Column | str, salt: str = "ab-v1") -> Column:
    """Stable position of an id in [0, 1]."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), col(id_).cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / dec(4294967295)


def assign_variant(id_: Column | str, traffic: float, salt: str = "ab-v1") -> Column:
    if traffic <= 0:
        return F.lit("champion")
    return F.when(traffic_bucket(id_, salt) < traffic, "challenger").otherwise("champion")


def served_variant(variant: Column, p_champion: Column, p_challenger: Column) -> Column:
    """Struct (variant, probability): a challenger without an answer falls back to the champion."""
    falls_back = (variant == "challenger") & p_challenger.isNull()
    name = F.when(falls_back, F.lit("champion")).otherwise(variant)
    return F.struct(
        name.alias("variant"),
        F.when(name == "challenger", p_challenger).otherwise(p_champion).alias("probability"),
    )


def fingerprint(names: list[str]) -> Column:
    """sha256 of the name-sorted compact JSON of a record; NULLs are kept in the text."""
    record = F.struct(*[F.col(n) for n in sorted(names)])
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def parse_reasons(c: Column | str) -> Column:
    """JSON array, bare text or nothing, as an array of strings."""
    text = col(c)
    parsed = F.from_json(text, "array<string>")
    bare = F.when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.coalesce(parsed, bare)


# --- Fixed values: accepted range of each application field (low, high, required) ------------------
APPLICATION_RANGES = {
    "loan_amnt": (500, 40000, True),
    "int_rate": (5, 31, True),
    "installment": (0, 5000, True),
    "emp_length_years": (0, 10, False),
    "dti": (0, 100, True),
    "delinq_2yrs": (0, 200, True),
    "fico_score": (300, 850, True),
    "inq_last_6mths": (0, 200, True),
    "open_acc": (0, 200, True),
    "pub_rec": (0, 200, True),
    "revol_bal": (0, 10_000_000, True),
    "revol_util": (0, 200, False),
    "total_acc": (0, 200, True),
    "mort_acc": (0, 200, False),
    "pub_rec_bankruptcies": (0, 200, False),
    "credit_history_months": (0, 1200, True),
}
APPLICATION_LISTS = {
    "grade": ("A", "B", "C", "D", "E", "F", "G"),
    "home_ownership": ("MORTGAGE", "RENT", "OWN", "OTHER"),
    "verification_status": ("Not Verified", "Source Verified", "Verified"),
    "purpose": C.PURPOSES,
    "addr_state": C.STATES,
    "application_type": ("Individual", "Joint App"),
    "initial_list_status": ("w", "f"),
}
# -------------------------------------------------------------------------------------------------


def application_errors(id_column: str = "loan_id") -> Column:
    """Array with one code per broken field rule; empty for a valid application."""

    def unless(ok: Column, code: str) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(code))

    checks = []
    for name, (low, high, required) in APPLICATION_RANGES.items():
        inside = F.col(name).between(low, high)
        checks.append(unless(inside if required else inside | F.col(name).isNull(), name))
    checks.append(unless((F.col("annual_inc") > 0) & (F.col("annual_inc") <= 10_000_000), "annual_inc"))
    checks.append(unless(F.col("term_months").isin(36, 60), "term_months"))
    for name, accepted in APPLICATION_LISTS.items():
        checks.append(unless(F.col(name).isin(*accepted), name))
    checks.append(unless(F.col("sub_grade").rlike(C.SUB_GRADE_PATTERN), "sub_grade"))
    checks.append(unless(F.startswith(F.col("sub_grade"), F.col("grade")), "sub_grade_vs_grade"))
    checks.append(unless(F.col(id_column).isNull() | F.col(id_column).rlike(C.ID_PATTERN), id_column))
    return F.array_compact(F.array(*checks))
