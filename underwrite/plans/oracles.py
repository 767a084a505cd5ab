"""SQL fragments of the oracle engine shared by several counterparts."""

from __future__ import annotations

from underwrite import config as C
from underwrite.plans import views as V

SNAPSHOT = "2001-01-01"


def number(source: str) -> str:
    return rf"try_cast(nullif(regexp_replace({source}, '[^0-9.\-]', '', 'g'), '') as double)"


def month(source: str) -> str:
    return f"try_strptime(trim({source}), '%b-%Y')"


def text_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def months_between(a: str, b: str) -> str:
    return f"((year({b}) - year({a})) * 12 + month({b}) - month({a}))"


def case_map(source: str, mapping: dict, default: str = "null") -> str:
    whens = " ".join(f"when {source} = '{k}' then {v!r}" for k, v in mapping.items())
    return f"case {whens} else {default} end"


def numeric(feature: C.Numeric) -> str:
    if feature.name == "emp_length_years":
        return case_map("trim(emp_length)", C.EMPLOYMENT_YEARS)
    if feature.name == "fico_score":
        low, high = number("fico_range_low"), number("fico_range_high")
        return f"({low} + coalesce({high}, {low})) / 2.0"
    if feature.name == "credit_history_months":
        return f"cast({months_between(month('earliest_cr_line'), month('issue_d'))} as double)"
    return number(feature.source)


def category(feature: C.Categorical) -> str:
    text = f"trim({feature.source})"
    aliases = C.CATEGORY_ALIASES.get(feature.name)
    return case_map(text, aliases, text) if aliases else text


def features_at(snapshot: str) -> str:
    return features().replace(SNAPSHOT, snapshot)


def canonical() -> str:
    """CTEs ``raw_loans`` and ``canonical``."""
    status = "trim(loan_status)"
    issue = month("issue_d")
    columns = [f"trim(id) as loan_id, {issue} as issue_month"]
    columns += [f"cast({numeric(f)} as double) as {f.name}" for f in C.NUMERIC_FEATURES]
    columns += [f"{category(f)} as {f.name}" for f in C.CATEGORICAL_FEATURES]
    matured = f"coalesce({months_between(issue, f"timestamp '{SNAPSHOT}'")} >= {number('term')}, false)"
    label = (
        f"case when {matured} then case when {status} in {text_list(C.POSITIVE_STATUS)} then 1.0e0 "
        f"when {status} in {text_list(C.NEGATIVE_STATUS)} then 0.0e0 end end"
    )
    columns += [f"{status} as loan_status", f"{label} as target_default"]
    raw = V.oracle(V.RAW_LOANS)
    return (
        f"raw_loans as ({raw}), canonical as (select {', '.join(columns)} from raw_loans "
        "where try_cast(loan_amnt as double) is not null)"
    )


def in_ranges() -> str:
    parts = []
    for f in C.NUMERIC_FEATURES:
        if f.low is not None:
            parts.append(f"coalesce({f.name} >= {f.low}, true)")
        if f.high is not None:
            parts.append(f"coalesce({f.name} <= {f.high}, true)")
    return " and ".join(parts)


DERIVED = {
    "loan_to_income": "case when annual_inc > 0 then loan_amnt / annual_inc end",
    "installment_to_income": "case when annual_inc > 0 then installment * 12 / annual_inc end",
    "revol_bal_to_income": "case when annual_inc > 0 then revol_bal / annual_inc end",
    "open_acc_ratio": "case when total_acc > 0 then open_acc / total_acc end",
    "log_annual_inc": "case when annual_inc is not null then ln(1 + greatest(annual_inc, 0)) end",
}


def features() -> str:
    """CTEs up to ``features``: clean canonical rows with the derived ratios."""
    derived = ", ".join(f"{e} as {n}" for n, e in DERIVED.items())
    return f"{canonical()}, features as (select *, {derived} from canonical where {in_ranges()})"


def tail(z: str) -> str:
    """Two-sided normal tail: one minus the error function as a series of positive terms."""
    x = f"(abs({z}) / sqrt(2.0))"
    term = f"exp((2 * k + 1) * ln({x}) - {x} * {x} - lgamma(k + 1.5))"
    series = f"list_sum(list_transform(range(0, 150), lambda k: {term}))"
    return f"(case when {z} is null then null when {z} = 0 then 1.0 when abs({z}) > 8 then 0.0 else greatest(0, 1 - {series}) end)"


def wilson(k: str, n: str) -> tuple[str, str]:
    z = C.Z_95
    p = f"({k} * 1.0 / {n})"
    center = f"({p} + {z * z} / (2.0 * {n})) / (1 + {z * z} / {n})"
    half = f"{z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4.0 * {n} * {n})) / (1 + {z * z} / {n})"
    return f"({center} - {half})", f"({center} + {half})"


def band(p: str) -> str:
    whens = " ".join(f"when {p} < {limit} then '{letter}'" for limit, letter in C.RISK_BANDS)
    return f"case {whens} when {p} is not null then '{C.LAST_BAND}' end"


def bucket(id_: str, salt: str = "ab-v1") -> str:
    return f"(cast(('0x' || substr(sha256('{salt}:' || cast({id_} as varchar)), 1, 8)) as bigint) / 4294967295.0)"


def digitize(x: str, edges) -> str:
    return "(" + " + ".join(f"cast({x} >= {e!r}::double as int)" for e in edges) + ")"


def counted(source: str, label: str, score: str, keys: str = "") -> str:
    """CTEs ``c`` (counts per score) and ``r`` (cumulative counts and totals) over a source."""
    lead = f"{keys}, " if keys else ""
    part = f"partition by {keys} " if keys else ""
    return (
        f"c as (select {lead}{score} as s, sum({label})::bigint as pos, sum(1 - {label})::bigint as neg from {source} "
        f"where {label} is not null and {score} is not null group by all), "
        f"r as (select *, sum(pos) over ({part}order by s) as pc, sum(neg) over ({part}order by s) as nc, "
        f"sum(pos) over ({part.strip()}) as m, sum(neg) over ({part.strip()}) as n from c)"
    )


AUC = "sum(pos * (nc - neg / 2.0)) / (max(m) * 1.0 * max(n))"
KS = "max(abs(pc * 1.0 / m - nc * 1.0 / n))"
AP = "sum(pos * 1.0 / m * (m - pc + pos) / (m - pc + pos + n - nc + neg))"


def delong(keys: str = "") -> str:
    """CTE ``d`` over ``r``: auc and standard error per key."""
    lead = f"{keys}, " if keys else ""
    group = f"group by {keys}" if keys else ""
    v01 = "((nc - neg / 2.0) / n)"
    v10 = "((pc - pos / 2.0) / m)"

    def variance(weight: str, v: str, size: str) -> str:
        return f"((sum({weight} * {v} * {v}) - sum({weight} * {v}) * sum({weight} * {v}) / max({size})) / (max({size}) - 1) / max({size}))"

    return (
        f"d as (select {lead}(max(m) + max(n))::bigint as n_rows, max(m)::bigint as n_pos, {AUC} as auc, "
        f"sqrt({variance('pos', v01, 'm')} + {variance('neg', v10, 'n')}) as se, {KS} as ks, "
        f"sum((pos + neg) * s) as sum_s from r {group})"
    )


def bootstrap(source: str, label: str, score: str, n: int, keys: str = "", seed: int = 42) -> str:
    """CTEs up to ``bs``: weighted and cumulated counts of every replicate (0 is the data), both classes present.

    The same draws as the library's: linear hashes of the score's digest, inverted to Poisson weights.
    """
    lead = f"{keys}, " if keys else ""
    key = f"coalesce({keys}::varchar, '~') || ':' || " if keys else ""

    def digits(text: str, at: int) -> str:
        return f"('0x' || substr({text}, {at}, 7))::bigint"

    numbers = ", ".join(
        f"{digits(f"md5('{seed}:' || r || ':{j}')", at)} as {name}{j}" for j in range(4) for name, at in (("a", 1), ("b", 8), ("c", 15))
    )
    u = [f"(((h1 * a{j} % 2147483647 + h2 * b{j} % 2147483647 + c{j}) % 2147483647 + 0.5e0) / 2147483647.0e0)" for j in range(4)]

    def weight(side: str, j: int) -> str:
        c = f"{side}::double"
        z = f"(sqrt(-2.0e0 * ln({u[j]})) * cos(6.283185307179586e0 * {u[j + 1]}))"
        wide = f"greatest(floor({c} + sqrt({c}) * {z} + ({z} * {z} - 1) / 6.0e0 + ({z} - {z} * {z} * {z}) / (72.0e0 * sqrt({c})) + 0.5e0), 0)"
        return f"case when r = 0 then {c} when {side} = 0 then 0 when {side} <= 12 then len(list_filter(s_{side}, lambda e: e <= {u[j]})) else {wide} end"

    def steps(side: str) -> str:
        return (
            f"case when {side} between 1 and 12 then list_transform(range(1, 45), lambda k: list_sum(list_transform(range(0, k), "
            f"lambda i: exp(i * ln({side}::double) - {side}::double - lgamma(i + 1.0))))) end as s_{side}"
        )

    part = f"partition by {lead}r"
    return (
        f"bc as (select {lead}{score}::double as s, sum({label})::bigint as pos, sum(1 - {label})::bigint as neg from {source} where {label} is not null and {score} is not null group by all), "
        f"bd as (select *, md5({key}trunc(case when abs(s) < 1000 then s * 4503599627370496.0e0 else s end)::bigint::varchar) as h, {steps('pos')}, {steps('neg')} from bc), "
        f"bh as (select *, {digits('h', 1)} as h1, {digits('h', 8)} as h2 from bd), "
        f"br as (select r, {numbers} from (select unnest(range(0, {n + 1})) as r)), "
        f"bw as (select {lead}r, s, {weight('pos', 0)} as wp, {weight('neg', 2)} as wn from bh, br), "
        f"bs as (select *, sum(wp) over ({part} order by s) as pc, sum(wn) over ({part} order by s) as nc, sum(wp) over ({part}) as m, sum(wn) over ({part}) as n "
        "from bw qualify m > 0 and n > 0)"
    )


#: Metrics of one replicate over ``bs``.
BOOTSTRAP_METRICS = {
    "roc_auc": "sum(wp * (nc - wn / 2) / (m * n))",
    "ks": "max(abs(pc / m - nc / n))",
    "pr_auc": "sum(case when m - pc + wp + n - nc + wn > 0 then wp / m * (m - pc + wp) / (m - pc + wp + n - nc + wn) else 0 end)",
}


def bootstrap_interval(metrics: dict[str, str]) -> str:
    """Estimate and percentile interval of each metric over ``bs``."""
    parts = [
        f"select '{name}' as metric, max(v) filter (where r = 0) as estimate, quantile_cont(v, 0.025) filter (where r > 0) as ci_low, quantile_cont(v, 0.975) filter (where r > 0) as ci_high, "
        f"count(*) filter (where r > 0) as n_boot from (select r, {rule} as v from bs group by r)"
        for name, rule in metrics.items()
    ]
    return " union all ".join(parts)
