"""Classification metrics, inference, calibration, gains and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from underwrite import config as C
from underwrite.functions import scoring as S
from underwrite.functions import stats as ST
from underwrite.operators import analysis as A
from underwrite.operators import comparison as CMP
from underwrite.operators import delong as D
from underwrite.operators import metrics as M
from underwrite.operators.bootstrap import Metric, bootstrap_interval
from underwrite.operators.counts import average_rank, ranked, score_counts
from underwrite.operators.scan import ntile
from underwrite.plans import oracles as O
from underwrite.plans import views as V
from underwrite.plans.registry import register, rounded

LINES = V.oracle(V.SCORED_LINES)
LOANS = V.oracle(V.SCORED_LOANS)
MODELS = ["p_a", "p_b", "p_c"]
GATES = C.QualityGates()


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return V.view(spark, sf, V.SCORED_LINES)


def loans(spark: SparkSession, sf: str) -> DataFrame:
    return V.view(spark, sf, V.SCORED_LOANS)


def base(score: str = "p_a", keys: str = "", source: str = LINES) -> str:
    return f"with b as ({source}), {O.counted('b', 'y', score, keys)}"


# --- D24-D33: metrics from score counts ----------------------------------------------------------
@register("d24_auc_gini", f"{base('p_a', 'quarter')} select quarter, {O.AUC} as roc_auc, 2 * {O.AUC} - 1 as gini from r group by quarter")
def auc_gini(spark, sf):
    report = M.classification_report(lines(spark, sf), "y", "p_a", keys=["quarter"])
    return rounded(report.select("quarter", "roc_auc", "gini"))


@register("d25_average_precision", f"{base()} select {O.AP} as pr_auc from r")
def average_precision(spark, sf):
    return rounded(M.classification_report(lines(spark, sf), "y", "p_a").select("pr_auc"))


@register("d26_ks_separation", f"{base('p_a', 'l_linenumber')} select l_linenumber, {O.KS} as ks from r group by l_linenumber")
def ks_separation(spark, sf):
    return rounded(M.classification_report(lines(spark, sf), "y", "p_a", keys=["l_linenumber"]).select("l_linenumber", "ks"))


@register(
    "d27_brier_log_loss",
    f"select avg((p_a - y) * (p_a - y)) as brier, avg(-(y * ln(p_a) + (1 - y) * ln(1 - p_a))) as log_loss from ({LINES}) where y is not null",
)
def brier_log_loss(spark, sf):
    return rounded(M.classification_report(lines(spark, sf), "y", "p_a").select("brier", "log_loss"))


ECE_BIN = O.digitize("p_a", M.ECE_EDGES)
ECE = (
    f"(select sum(n * abs(mp - my)) / sum(n) from (select {ECE_BIN} as bin, count(*) as n, avg(p_a) as mp, avg(y) as my from b "
    "where y is not null group by 1))"
)


@register("d28_calibration_error", f"with b as ({LINES}) select {ECE} as ece")
def calibration_error(spark, sf):
    return rounded(M.classification_report(lines(spark, sf), "y", "p_a").select("ece"))


@register(
    "d29_confusion_rates",
    "select quarter, pr as precision, rc as recall, case when pr + rc = 0 then 0 else 2 * pr * rc / (pr + rc) end as f1, "
    "observed as default_rate_observed, predicted as default_rate_predicted from (select quarter, "
    "coalesce(sum(y) filter (where p_a >= 0.3) / nullif(count(*) filter (where p_a >= 0.3), 0), 0) as pr, "
    "coalesce(sum(y) filter (where p_a >= 0.3) / nullif(sum(y), 0), 0) as rc, avg(y) as observed, avg(p_a) as predicted "
    f"from ({LINES}) where y is not null group by quarter)",
)
def confusion_rates(spark, sf):
    report = M.classification_report(lines(spark, sf), "y", "p_a", 0.3, ["quarter"])
    return rounded(
        report.select("quarter", "precision", "recall", "f1", "default_rate_observed", "default_rate_predicted")
    )


SPLIT = "case when issue_month < timestamp '1997-01-01' then 'train' when issue_month < timestamp '1999-01-01' then 'validation' else 'test' end"


@register(
    "d30_fit_diagnosis",
    f"with b as (select *, {SPLIT} as split from ({LOANS})), {O.counted('b', 'y', 'p_a', 'split')}, "
    f"a as (select split, {O.AUC} as auc from r group by split), w as (select max(auc) filter (where split = 'train') as train_auc, "
    "max(auc) filter (where split = 'test') as test_auc from a) select train_auc, test_auc, train_auc - test_auc as auc_gap, "
    "case when train_auc - test_auc > 0.07 then 'sobreajuste' when train_auc < 0.65 and test_auc < 0.65 then 'subajuste' "
    "else 'buen_ajuste' end as fit_diagnosis from w",
)
def fit_diagnosis(spark, sf):
    aucs = D.auc_interval(split_loans(spark, sf), "y", "p_a", ["split"])
    wide = aucs.agg(*[F.max(F.when(F.col("split") == s, F.col("auc"))).alias(f"{s}_auc") for s in ("train", "test")])
    return rounded(
        wide.select(
            "*",
            (F.col("train_auc") - F.col("test_auc")).alias("auc_gap"),
            M.diagnose_fit("train_auc", "test_auc").alias("fit_diagnosis"),
        )
    )


def split_loans(spark: SparkSession, sf: str) -> DataFrame:
    month = F.col("issue_month")
    split = F.when(month < F.lit("1997-01-01").cast("timestamp"), "train").when(
        month < F.lit("1999-01-01").cast("timestamp"), "validation"
    )
    return loans(spark, sf).withColumn("split", split.otherwise("test"))


def grid_sql(grid, source: str, keys: str = "") -> str:
    """CTE ``g``: confusion counts of each threshold, straight from the rows."""
    values = ", ".join(f"({t!r}::double)" for t in grid)
    lead = f"{keys}, " if keys else ""
    return (
        f"b as (select * from ({source}) where y is not null), t(threshold) as (values {values}), "
        f"g as (select {lead}threshold, sum(y) filter (where p_a >= threshold) as tp, count(*) filter (where p_a >= threshold and y = 0) as fp, "
        "coalesce(sum(y) filter (where p_a < threshold), 0) as fn, count(*) filter (where p_a < threshold and y = 0) as tn, count(*) as n "
        f"from b, t group by {lead}threshold)"
    )


@register(
    "d31_optimal_threshold",
    f"with {grid_sql(M.THRESHOLD_GRID, LINES, 'l_linenumber')} select l_linenumber, arg_min(threshold, (5 * fn + fp) + threshold / 1000) as threshold, "
    "cast(min(5 * fn + fp) as double) as cost from g group by l_linenumber",
)
def optimal_threshold(spark, sf):
    return rounded(M.optimal_threshold(lines(spark, sf), "y", "p_a", keys=["l_linenumber"]))


CURVE = (
    "select threshold, (fn + tn) / n as approval_rate, fn / nullif(fn + tn, 0) as bad_rate_approved, "
    "coalesce(tp, 0) / greatest(coalesce(tp, 0) + fn, 1) as recall, coalesce(tp, 0) / greatest(coalesce(tp, 0) + fp, 1) as precision, "
    "(5.0 * fn + fp) / n as expected_cost from g"
)


@register("d32_threshold_curve", f"with {grid_sql(M.CURVE_GRID, LOANS)} {CURVE}")
def threshold_curve(spark, sf):
    return rounded(M.threshold_curve(loans(spark, sf), "y", "p_a"))


@register(
    "c06_row_threshold_grid",
    f"with {grid_sql(M.CURVE_GRID, LINES, 'quarter')} select quarter, threshold, coalesce(tp, 0)::bigint as tp, fp, fn::bigint as fn, tn from g",
)
def row_threshold_grid(spark, sf):
    return rounded(M.threshold_counts(lines(spark, sf), "y", "p_a", M.CURVE_GRID, ["quarter"]).drop("step"))


@register(
    "d33_curve_points",
    f"{base('p_a', '', LOANS)}, k as (select *, row_number() over (order by s desc) as position, count(*) over () as size from r) "
    "select position, s as threshold, (n - nc + neg) / n as fpr, (m - pc + pos) / m as tpr, "
    "(m - pc + pos) / (m - pc + pos + n - nc + neg) as precision from k "
    "where floor(floor((position * 199 + size - 1) / size) * size / 199) = position",
)
def curve_points(spark, sf):
    return rounded(M.curve_points(loans(spark, sf), "y", "p_a"))


def corners_sql(points: int, source: str) -> str:
    """Corner points of the curve over ``source``, thinned."""
    return (
        f"{base('p_c', '', source)}, w as (select *, lead(pos) over (order by s desc) as pos_ahead, lead(neg) over (order by s desc) as neg_ahead, lag(s) over (order by s desc) as before from r), "
        "k as (select *, row_number() over (order by s desc) as position, count(*) over () as size from w where before is null or pos_ahead is null or pos_ahead <> pos or neg_ahead <> neg) "
        f"select position, s as threshold, (n - nc + neg) / n as fpr, (m - pc + pos) / m as tpr from k where floor(floor((position * {points - 1} + size - 1) / size) * size / {points - 1}) = position"
    )


@register("d33_roc_corners", corners_sql(50, LOANS))
def roc_corners(spark, sf):
    return rounded(M.roc_corners(loans(spark, sf), "y", "p_c", 50))


@register("d33_roc_corners_of_ties", corners_sql(200, LINES))
def roc_corners_of_ties(spark, sf):
    """Few scores with many rows each: hardly a point is on a line."""
    return rounded(M.roc_corners(lines(spark, sf), "y", "p_c", 200))


@register(
    "d55_nearest_threshold",
    f"with {grid_sql(M.CURVE_GRID, LOANS)} {CURVE} order by abs(threshold - 0.287), threshold limit 1",
)
def nearest_threshold(spark, sf):
    return rounded(A.nearest_threshold(M.threshold_curve(loans(spark, sf), "y", "p_a"), 0.287))


# --- W1-W3, W8: ordered scans --------------------------------------------------------------------
@register(
    "w01_average_rank",
    digits=9,
    sql=f"select l_linenumber, p_a, count(*) as n, avg(rn) as avg_rank from (select l_linenumber, p_a, row_number() over (partition by l_linenumber order by p_a) as rn from ({LINES})) group by all",
)
def average_ranks(spark, sf):
    return rounded(average_rank(lines(spark, sf), "p_a", ["l_linenumber"]), 9)


@register("w02_cumulative_counts", digits=9, sql=f"{base('p_a', '', LOANS)} select s as score, pos, neg, pc::bigint as pos_cum, nc::bigint as neg_cum, m::bigint as pos_all, n::bigint as neg_all from r")
def cumulative_counts(spark, sf):
    return rounded(ranked(score_counts(loans(spark, sf), "y", "p_a")), 9)


@register(
    "w03_ntile",
    f"select loan_id, cast(ntile(7) over (order by p_c desc, loan_id) as int) as tile from ({LOANS})",
)
def ntiles(spark, sf):
    rows = loans(spark, sf).select("loan_id", (-F.col("p_c")).alias("down"))
    return ntile(rows, [], ["down", "loan_id"], 7).select("loan_id", "tile")


# --- D34-D38, W4, C4: inference ------------------------------------------------------------------
Z = C.Z_95
INTERVAL = f"auc, se, greatest(auc - {Z} * se, 0) as ci_low, least(auc + {Z} * se, 1) as ci_high"


@register("d34_auc_interval", f"{base('p_a', 'quarter')}, {O.delong('quarter')} select quarter, n_rows as n, n_pos, {INTERVAL} from d")
def auc_interval(spark, sf):
    return rounded(D.auc_interval(lines(spark, sf), "y", "p_a", ["quarter"]))


LONG = f"(select y, unnest(['p_a', 'p_b', 'p_c']) as model, unnest([p_a, p_b, p_c]) as p from ({LINES}))"


@register("d36_auc_table", f"{base('p', 'model', LONG)}, {O.delong('model')} select model, n_rows as n, n_pos, {INTERVAL} from d")
def auc_table(spark, sf):
    return rounded(D.auc_table(lines(spark, sf), "y", MODELS))


def paired_sql(source: str, models: list[str], pairs: list[tuple[str, str]]) -> str:
    """CTE ``q``: pair, models, AUCs, delta, variance by row-level placement values."""
    places = []
    for x in models:
        less = f"(order by {x} range between unbounded preceding and current row)"
        tied = f"(partition by {x})"
        neg, pos = "1 - y", "y"
        places.append(f"(sum({neg}) over {less} - sum({neg}) over {tied} / 2.0) / (count(*) filter (where y = 0) over ()) as v_{x}")
        places.append(f"(sum({pos}) over {less} - sum({pos}) over {tied} / 2.0) / (count(*) filter (where y = 1) over ()) as w_{x}")
    parts = []
    for i, (a, b) in enumerate(pairs):
        var = (
            f"var_samp(v_{a} - v_{b}) filter (where y = 1) / count(*) filter (where y = 1) + "
            f"var_samp(w_{a} - w_{b}) filter (where y = 0) / count(*) filter (where y = 0)"
        )
        parts.append(
            f"select {i + 1} as pair, '{a}' as model_a, '{b}' as model_b, avg(v_{a}) filter (where y = 1) as auc_a, "
            f"avg(v_{b}) filter (where y = 1) as auc_b, {var} as variance from pl"
        )
    return (
        f"b as (select * from ({source}) where y is not null), pl as (select y, {', '.join(places)} from b), "
        f"q0 as ({' union all '.join(parts)}), q as (select pair, model_a, model_b, auc_a, auc_b, auc_a - auc_b as delta, sqrt(variance) as se, "
        "(auc_a - auc_b) / sqrt(variance) as z from q0)"
    )


ALL_PAIRS = [("p_a", "p_b"), ("p_a", "p_c"), ("p_b", "p_c")]
PAIR_COLUMNS = f"pair, model_a, model_b, auc_a, auc_b, delta, se, z, {O.tail('z')} as p_value, delta - {Z} * se as ci_low, delta + {Z} * se as ci_high"


@register("d35_paired_delong", f"with {paired_sql(LINES, MODELS, ALL_PAIRS[:1])} select {PAIR_COLUMNS} from q")
def paired_delong(spark, sf):
    return rounded(D.paired_tests(lines(spark, sf), "y", ["p_a", "p_b"]))


HOLM = (
    "hr as (select *, row_number() over (order by p_value, pair) as rk, count(*) over () as fam from h), "
    "hh as (select *, least(1, max(p_value * (fam - rk + 1)) over (order by rk)) as p_holm from hr)"
)
READING = (
    "case when p_holm < 0.05 and abs(delta) >= 0.005 then 'Diferencia significativa y material a favor de ' || "
    "case when delta > 0 then 'A' else 'B' end when p_holm < 0.05 then 'Estadísticamente significativa pero prácticamente irrelevante' "
    "when abs(delta) >= 0.005 then 'Diferencia de tamaño relevante pero no concluyente (incertidumbre alta)' "
    "else 'Sin evidencia de diferencia: modelos prácticamente equivalentes' end"
)
PAIRWISE = f"{paired_sql(LOANS, MODELS, ALL_PAIRS)}, h as (select {PAIR_COLUMNS} from q), {HOLM}"


@register("d37_pairwise_comparison", f"with {PAIRWISE} select * exclude (rk, fam), {READING} as interpretation from hh")
def pairwise_comparison(spark, sf):
    return rounded(CMP.pairwise_comparison(loans(spark, sf), "y", MODELS))


@register(
    "d38_difference_reading",
    f"with q as (select o_orderkey, ((o_orderkey % 41) - 20) / 1000.0e0 as delta, (o_orderkey % 10) / 50.0e0 as p_holm from orders) "
    f"select o_orderkey, {READING} as reading from q",
)
def difference_reading(spark, sf):
    delta = ((F.col("o_orderkey") % 41) - 20) / F.lit(1000.0)
    p = (F.col("o_orderkey") % 10) / F.lit(50.0)
    reading = ST.interpret_difference(delta, p, 0.005, 0.05)
    return V.table(spark, sf, "orders").select("o_orderkey", reading.alias("reading"))


FAMILY = "select o_custkey, o_orderkey, (o_orderkey % 997) / 9970.0e0 as p from orders"


@register(
    "w04_holm",
    f"select o_custkey, o_orderkey, p, least(1, max(p * (fam - rk + 1)) over (partition by o_custkey order by rk)) as p_holm from "
    f"(select *, row_number() over (partition by o_custkey order by p, o_orderkey) as rk, count(*) over (partition by o_custkey) as fam from ({FAMILY}))",
)
def holm(spark, sf):
    rows = V.table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", ((F.col("o_orderkey") % 997) / F.lit(9970.0)).alias("p")
    )
    return rounded(CMP.holm(rows, "p", ["o_custkey"], "o_orderkey"))


@register("c04_model_pairs", "select pair, model_a, model_b, n from (values (1, 'p_a', 'p_b'), (2, 'p_a', 'p_c'), (3, 'p_b', 'p_c')) t(pair, model_a, model_b), "
          f"(select count(*) as n from ({LINES}) where y is not null)")
def model_pairs(spark, sf):
    pairs = D.paired_tests(lines(spark, sf), "y", MODELS).select("pair", "model_a", "model_b")
    n = lines(spark, sf).filter("y is not null").agg(F.count(F.lit(1)).alias("n")).scalar()
    return pairs.withColumn("n", n)


@register("d54_pair_orientation", f"with {PAIRWISE} select 'p_b' as model_a, case when model_b = 'p_b' then model_a else model_b end as model_b, "
          "case when model_b = 'p_b' then -delta else delta end as delta, case when model_b = 'p_b' then -ci_high else ci_low end as ci_low, "
          "case when model_b = 'p_b' then -ci_low else ci_high end as ci_high, p_holm from hh where 'p_b' in (model_a, model_b)")
def pair_orientation(spark, sf):
    return rounded(CMP.orient_pairs(CMP.pairwise_comparison(loans(spark, sf), "y", MODELS), "p_b"))


# --- D39, D43, X4: bootstrap ---------------------------------------------------------------------
@register("d39_bootstrap_interval", f"with b as ({LINES}), {O.bootstrap('b', 'y', 'p_a', 300)} {O.bootstrap_interval(O.BOOTSTRAP_METRICS)}")
def bootstrap(spark, sf):
    return rounded(bootstrap_interval(lines(spark, sf), "y", "p_a", n=300))


@register(
    "x04_custom_bootstrap_metric",
    f"with b as ({LINES}), {O.bootstrap('b', 'y', 'p_a', 200)} {O.bootstrap_interval({'recall_at_30': 'sum(case when s >= 0.3 then wp else 0 end / m)'})}",
)
def custom_metric(spark, sf):
    """A metric supplied by the caller as an aggregate over weighted score counts."""

    def recall_at_30(score, pos, neg, pos_cum, neg_cum, pos_all, neg_all):
        return F.when(score >= 0.3, pos).otherwise(F.lit(0.0)) / pos_all

    custom = {"recall_at_30": Metric(recall_at_30)}
    return rounded(bootstrap_interval(lines(spark, sf), "y", "p_a", [], n=200, custom=custom))


@register(
    "d43_discrimination_block",
    f"{base()}, {O.delong()}, {O.bootstrap('b', 'y', 'p_a', 300)}, bi as ({O.bootstrap_interval(O.BOOTSTRAP_METRICS)}) select auc, greatest(auc - {Z} * se, 0) as auc_ci_low, least(auc + {Z} * se, 1) as auc_ci_high, 2 * auc - 1 as gini, "
    f"ks, (select {O.AP} from r) as pr_auc, n_pos / n_rows as prevalence, {', '.join(f'(select {c} from bi where metric = {chr(39)}{m}{chr(39)}) as {m}_{c}' for m in ('ks', 'pr_auc') for c in ('ci_low', 'ci_high'))} from d",
)
def discrimination_block(spark, sf):
    return rounded(A.discrimination_block(lines(spark, sf), "y", "p_a"))


# --- D41, D42: proportions -----------------------------------------------------------------------
@register(
    "d41_two_proportions",
    "with g as (select l_shipmode as k, a, m, b, n from (select l_linenumber as l_shipmode, count(*) filter (where l_returnflag = 'R' and l_linestatus = 'F') as a, "
    "count(*) filter (where l_linestatus = 'F') as m, count(*) filter (where l_returnflag = 'R' and l_linestatus = 'O') as b, "
    "count(*) filter (where l_linestatus = 'O') as n from lineitem group by 1)), "
    "q as (select k, case when least(m, n) = 0 then null when (a + b) in (0, m + n) then 0 else (a / m - b / n) / "
    "sqrt((a + b) / (m + n) * (1 - (a + b) / (m + n)) * (1.0 / m + 1.0 / n)) end as z from g) "
    f"select k as l_linenumber, z, {O.tail('z')} as p_value from q",
)
def two_proportions(spark, sf):
    def n(status: str, flag: str | None = None):
        hit = F.col("l_linestatus") == status
        return F.sum((hit if flag is None else hit & (F.col("l_returnflag") == flag)).cast("bigint"))

    counts = V.table(spark, sf, "lineitem").groupBy("l_linenumber").agg(
        n("F", "R").alias("a"), n("F").alias("m"), n("O", "R").alias("b"), n("O").alias("n")
    )
    tested = counts.withColumn("z", ST.two_proportion_z("a", "m", "b", "n"))
    return rounded(tested.select("l_linenumber", "z", ST.two_sided_p("z").alias("p_value")))


W_LO, W_HI = O.wilson("k", "n")


@register(
    "d42_wilson",
    f"select l_suppkey, n, {W_LO} as low, {W_HI} as high from (select l_suppkey, count(*) as n, count(*) filter (where l_returnflag = 'R') as k from lineitem group by 1)",
)
def wilson(spark, sf):
    counts = V.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("l_returnflag") == "R").cast("bigint")).alias("k")
    )
    low, high = ST.wilson("k", "n")
    return rounded(counts.select("l_suppkey", "n", low.alias("low"), high.alias("high")))


# --- D44-D50, D57, D58: calibration, gains, vintages ---------------------------------------------
CLIPPED = f"(select y, least(greatest(p_a, 1e-6), 1 - 1e-6) as p from ({LOANS}) where y is not null)"
SPIEGEL = "sum((y - p) * (1 - 2 * p)) / sqrt(sum((1 - 2 * p) * (1 - 2 * p) * p * (1 - p)))"


@register("d44_spiegelhalter", f"with q as (select {SPIEGEL} as z from {CLIPPED}) select z as spiegelhalter_z, {O.tail('z')} as spiegelhalter_p from q")
def spiegelhalter(spark, sf):
    return rounded(A.calibration_summary(loans(spark, sf), "y", "p_a").select("spiegelhalter_z", "spiegelhalter_p"))


def newton_sql(steps: int = 9) -> str:
    """Unrolled Newton steps of a two-parameter logistic fit."""
    ctes = [f"x as (select y, ln(p / (1 - p)) as x from {CLIPPED})", "s0 as (select 0.0e0 as a, 1.0e0 as b)"]
    for i in range(steps):
        ctes.append(
            f"m{i} as (select any_value(a) as a, any_value(b) as b, sum(y - f) as g0, sum((y - f) * x) as g1, sum(f * (1 - f)) as h0, "
            f"sum(f * (1 - f) * x) as h1, sum(f * (1 - f) * x * x) as h2 from (select y, x, a, b, 1 / (1 + exp(-(a + b * x))) as f from x, s{i}))"
        )
        ctes.append(
            f"s{i + 1} as (select a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) as a, b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) as b from m{i})"
        )
    return f"{', '.join(ctes)}, line as (select b as slope, a as intercept from s{steps})"


@register("d45_calibration_line", f"with {newton_sql()} select (select count(*) from x) as n, slope, intercept from line")
def calibration_line(spark, sf):
    return rounded(A.calibration_line(loans(spark, sf), "y", "p_a"))


RELIABLE = (
    f"p as (select * from {CLIPPED}), e as (select list_distinct(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) as q from p), "
    "inner_e as (select list_sort(q)[2:len(q) - 1] as q from e), t as (select 1 + len(list_filter(q, lambda v: v <= p.p)) as bin, count(*) as n, sum(y) as k, avg(p) as mean_pd from p, inner_e group by 1)"
)


@register("d46_reliability_table", f"with {RELIABLE} select cast(bin as int) as bin, n, mean_pd, k / n as observed, {W_LO} as ci_low, {W_HI} as ci_high from t")
def reliability(spark, sf):
    return rounded(A.reliability_table(loans(spark, sf), "y", "p_a"))


@register("d47_brier_reference", f"select count(*) as n, avg((p - y) * (p - y)) as brier, avg(y) * (1 - avg(y)) as brier_reference, avg(p) as mean_pd, avg(y) as observed_rate from {CLIPPED}")
def brier_reference(spark, sf):
    return rounded(A.calibration_summary(loans(spark, sf), "y", "p_a").select("n", "brier", "brier_reference", "mean_pd", "observed_rate"))


GAINS = (
    f"d as (select y, p_a, ntile(10) over (order by p_a desc, loan_id) as decile from ({LOANS}) where y is not null), "
    "g as (select decile, count(*) as n, sum(y) as k, avg(p_a) as mean_pd from d group by decile)"
)


@register(
    "d48_gains_table",
    f"with {GAINS} select cast(decile as int) as decile, n, k / n as default_rate, {W_LO} as ci_low, {W_HI} as ci_high, mean_pd, "
    "sum(k) over (order by decile) / sum(k) over () as cum_capture, sum(n) over (order by decile) / sum(n) over () as cum_population, "
    "(k / n) / (sum(k) over () / sum(n) over ()) as lift from g",
)
def gains_table(spark, sf):
    return rounded(A.decile_table(loans(spark, sf), "y", "p_a", "loan_id"))


VINTAGE = f"{base('p_a', 'quarter')}, {O.delong('quarter')}, v as (select quarter, n_rows as n, {INTERVAL}, ks, n_pos / n_rows as observed, sum_s / n_rows as mean_pd from d where n_pos >= 30 and n_pos < n_rows)"


@register("d49_vintage_stability", f"{VINTAGE} select * exclude (se) from v")
def vintage_stability(spark, sf):
    return rounded(A.vintage_stability(lines(spark, sf), "y", "p_a", "l_shipdate"))


@register(
    "d58_vintage_summary",
    f"{VINTAGE} select min(auc) as auc_min, max(auc) as auc_max, count(*) as n_vintages, max(quarter) as last_quarter, "
    "arg_max(mean_pd, quarter) as last_mean_pd, arg_max(observed, quarter) as last_observed from v",
)
def vintage_summary(spark, sf):
    return rounded(A.vintage_summary(A.vintage_stability(lines(spark, sf), "y", "p_a", "l_shipdate")))


@register(
    "d50_spearman",
    "select l_linenumber, count(*) as n, corr(ra, rb) as spearman from (select l_linenumber, "
    "rank() over (partition by l_linenumber order by l_quantity) + (count(*) over (partition by l_linenumber, l_quantity) - 1) / 2.0 as ra, "
    "rank() over (partition by l_linenumber order by l_discount) + (count(*) over (partition by l_linenumber, l_discount) - 1) / 2.0 as rb from lineitem) group by 1",
)
def spearman(spark, sf):
    return rounded(A.spearman(V.table(spark, sf, "lineitem"), ["l_linenumber"], "l_quantity", "l_discount"))


@register(
    "d56_gini_kept",
    f"{base('p', 'model', LONG)}, a as (select model, {O.AUC} as auc from r group by model), w as (select max(auc) filter (where model = 'p_a') as full_auc, "
    "max(auc) filter (where model = 'p_b') as without from a) select full_auc, without, case when full_auc > 0.5 then (without - 0.5) / (full_auc - 0.5) end as kept from w",
)
def gini_kept(spark, sf):
    aucs = D.auc_table(lines(spark, sf), "y", MODELS)
    wide = aucs.agg(
        F.max(F.when(F.col("model") == "p_a", F.col("auc"))).alias("full_auc"),
        F.max(F.when(F.col("model") == "p_b", F.col("auc"))).alias("without"),
    )
    return rounded(wide.select("*", A.gini_kept("full_auc", "without").alias("kept")))


@register(
    "d57_calibration_verdict",
    f"with {newton_sql()}, q as (select {SPIEGEL} as z, avg(p) as mean_pd, avg(y) as observed from {CLIPPED}) select intercept, "
    f"case when {O.tail('z')} < 0.05 or abs(intercept) > 0.05 then case when mean_pd > observed then 'sobreestima' else 'subestima' end else 'adecuada' end as verdict from q, line",
)
def calibration_verdict(spark, sf):
    rows = loans(spark, sf)
    line = A.calibration_line(rows, "y", "p_a").select("intercept").scalar()
    summary = A.calibration_summary(rows, "y", "p_a").withColumn("intercept", line)
    verdict = A.calibration_verdict(
        F.col("spiegelhalter_p"), F.col("intercept"), F.col("mean_pd"), F.col("observed_rate")
    )
    return rounded(summary.select("intercept", verdict.alias("verdict")))


# --- M9-M16: selection on k-row evidence ---------------------------------------------------------
BENCH_KEYS = "l_linenumber"
BENCH = (
    f"{base('p_a', BENCH_KEYS)}, bench as (select 'm' || {BENCH_KEYS} as algorithm, {O.AUC} as val_roc_auc, {O.AUC} - 0.6 as val_auc_gap, "
    f"{BENCH_KEYS} * 1.0e0 as latency_ms from r group by {BENCH_KEYS})"
)


def bench_frame(spark: SparkSession, sf: str) -> DataFrame:
    """A benchmark table derived from the lines: one candidate per line number."""
    aucs = D.auc_interval(lines(spark, sf), "y", "p_a", ["l_linenumber"])
    return aucs.select(
        F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("algorithm"),
        F.col("auc").alias("val_roc_auc"),
        (F.col("auc") - 0.6).alias("val_auc_gap"),
        F.col("l_linenumber").cast("double").alias("latency_ms"),
    )


ELIGIBLE = (
    "el as (select *, ok or not bool_or(ok) over () as eligible from (select *, latency_ms <= 5.0 and val_auc_gap <= 0.1 as ok from bench))"
)


@register("m09_eligible_candidates", f"{BENCH}, {ELIGIBLE} select algorithm, val_roc_auc, val_auc_gap, latency_ms, eligible from el")
def eligible_candidates(spark, sf):
    return rounded(CMP.eligible(bench_frame(spark, sf), C.QualityGates(max_overfit_gap=0.1)))


@register("m10_best_candidate", f"{BENCH}, {ELIGIBLE} select arg_max(algorithm, val_roc_auc) as algorithm, max(val_roc_auc) as val_roc_auc from el where eligible")
def best_candidate(spark, sf):
    rows = CMP.eligible(bench_frame(spark, sf), C.QualityGates(max_overfit_gap=0.1))
    return rounded(CMP.best_by(rows, "val_roc_auc"))


@register("o07_benchmark_order", f"{BENCH} select algorithm, val_roc_auc, row_number() over (order by val_roc_auc desc) as position from bench")
def benchmark_order(spark, sf):
    from pyspark.sql import Window as W

    order = W.partitionBy(F.lit(0)).orderBy(F.col("val_roc_auc").desc())
    rows = bench_frame(spark, sf).select("algorithm", "val_roc_auc")
    return rounded(rows.withColumn("position", F.row_number().over(order).cast("bigint")).orderBy("position"))


PARSIMONY = (
    f"{paired_sql(LOANS, MODELS, [('p_a', 'p_b'), ('p_a', 'p_c'), ('p_b', 'p_a'), ('p_b', 'p_c'), ('p_c', 'p_a'), ('p_c', 'p_b')])}, "
    "aucs as (select model_a as model, any_value(auc_a) as auc from q group by model_a), ref as (select arg_max(model, auc) as reference from aucs), "
    f"h as (select model_b as model, delta, {O.tail('z')} as p_value, row_number() over (order by model_b) as pair from q, ref where model_a = reference), {HOLM}, "
    "j as (select a.model, a.auc, reference, case when a.model = reference then 0 else delta end as delta_vs_best, "
    "case when a.model = reference then 1 else p_holm end as p_holm, true as eligible, "
    "case a.model when 'p_a' then 3 when 'p_b' then 2 else 99 end as complexity from aucs a left join hh on a.model = hh.model, ref), "
    "k as (select *, not (p_holm < 0.05 and delta_vs_best >= 0.005) as retained from j)"
)


@register(
    "m11_parsimonious_selection",
    f"with {PARSIMONY} select model, auc, delta_vs_best, p_holm, eligible, reference, complexity, retained, "
    "model = (select model from k where retained order by complexity, auc desc limit 1) as selected from k",
)
def parsimonious_selection(spark, sf):
    return rounded(CMP.select_parsimonious(loans(spark, sf), "y", MODELS, {"p_a": 3, "p_b": 2}))


LONG_LOANS = f"(select y, unnest(['p_a', 'p_b', 'p_c']) as model, unnest([p_a, p_b, p_c]) as p from ({LOANS}))"


@register(
    "m12_test_report",
    f"select * from (with {PAIRWISE} select 'pair' as section, model_a, model_b, auc_a, auc_b, delta, ci_low, ci_high, p_value, p_holm, {READING} as interpretation, null::bigint as n_rows from hh) "
    f"union all by name select * from ({base('p', 'model', LONG_LOANS)}, {O.delong('model')} select 'auc' as section, model as model_a, auc as auc_a, greatest(auc - {Z} * se, 0) as ci_low, least(auc + {Z} * se, 1) as ci_high, n_rows from d)",
)
def test_report(spark, sf):
    """AUC table and all pairs of three models."""
    return rounded(CMP.test_report(loans(spark, sf), "y", MODELS))


GATE_ROWS = (
    "select o_orderkey, 0.6 + (o_orderkey % 13) / 100.0e0 as auc, (o_orderkey % 17) / 100.0e0 as gap, 0.1 + (o_orderkey % 19) / 100.0e0 as brier, "
    "(o_orderkey % 8) * 1.0e0 as latency from orders"
)


@register(
    "m13_quality_gates",
    "select o_orderkey, array_to_string(list_filter([case when auc < 0.66 then printf('AUC test %.4f < 0.66', auc) end, "
    "case when gap > 0.08 then printf('brecha train-test %.4f > 0.08', gap) end, case when brier > 0.2 then printf('Brier %.4f > 0.2', brier) end, "
    f"case when latency > 5.0 then printf('latencia %.2fms > 5.0', latency) end], lambda x: x is not null), '|') as reasons from ({GATE_ROWS})",
)
def quality_gates(spark, sf):
    k = F.col("o_orderkey")
    hundred = F.lit(100.0)
    auc, gap, brier = (k % 13) / hundred + 0.6, (k % 17) / hundred, (k % 19) / hundred + 0.1
    reasons = CMP.gate_reasons(auc, gap, brier, (k % 8).cast("double"), GATES)
    return V.table(spark, sf, "orders").select("o_orderkey", F.array_join(reasons, "|").alias("reasons"))


@register(
    "m14_final_choice",
    f"{BENCH}, o as (select algorithm, val_auc_gap <= 0.1 as passed, row_number() over (order by val_roc_auc desc) as position from bench) "
    "select coalesce((select algorithm from o where passed order by position limit 1), 'tuned') as algorithm, "
    "case when exists (select 1 from o where passed) then 'fallback_default' else 'tuned' end as origin",
)
def final_choice(spark, sf):
    bench = benchmark_order(spark, sf).withColumn("passed", F.col("val_roc_auc") - 0.6 <= 0.1)
    tuned = bench.agg(F.lit("tuned").alias("algorithm"), (F.max("val_roc_auc") > 2).alias("passed"))
    return CMP.choose_final(tuned, bench)


@register(
    "m15_champion_vs_challenger",
    f"{base('p_a', 'quarter')}, a as (select quarter, {O.AUC} as new_auc from r group by quarter), w as (select quarter, new_auc, "
    "case when quarter = '1995Q1' then null else 0.7 end as old_auc from a) select quarter, old_auc is null or new_auc - old_auc >= 0.002 as promote, "
    "case when old_auc is null then 'no existe champion: el primer modelo válido se promueve' when new_auc - old_auc >= 0.002 then "
    "'challenger mejora AUC en ' || printf('%+.4f', new_auc - old_auc) else 'mejora insuficiente (' || printf('%+.4f', new_auc - old_auc) || ' < 0.002)' end as reason from w",
)
def champion_vs_challenger(spark, sf):
    aucs = D.auc_interval(lines(spark, sf), "y", "p_a", ["quarter"])
    old = F.when(F.col("quarter") != "1995Q1", F.lit(0.7))
    return aucs.select("quarter", CMP.champion_vs_challenger(F.col("auc"), old).alias("v")).select("quarter", "v.*")


@register(
    "m16_comparable_source",
    "select c_custkey, coalesce(case c_custkey % 3 when 0 then 'real' when 1 then 'synthetic' end = coalesce(case when c_custkey % 2 = 0 then 'synthetic' end, 'real'), false) as comparable from customer",
)
def comparable_source(spark, sf):
    k = F.col("c_custkey")
    champion = F.when(k % 3 == 0, "real").when(k % 3 == 1, "synthetic")
    return V.table(spark, sf, "customer").select(
        "c_custkey", CMP.same_data_source(champion, F.when(k % 2 == 0, "synthetic")).alias("comparable")
    )


@register(
    "m22_lineage_check",
    "select c_custkey, case c_custkey % 4 when 0 then 'falta el tag ''git_sha''|falta el tag ''test_end''' when 1 then "
    "'falta el tag ''git_sha''|''gold_delta_version'' sin resolver (DESCRIBE HISTORY falló)' when 2 then 'falta el tag ''git_sha''' else '' end as problems from customer",
)
def lineage_check(spark, sf):
    k = F.col("c_custkey") % 4
    values = {
        "git_sha": F.when(k == 3, "abc").when(k == 1, " "),
        "gold_table": F.lit("t"),
        "gold_delta_version": F.when(k == 1, "unknown").otherwise("7"),
        "data_source": F.lit("real"),
        "train_end": F.lit("1997-01-01"),
        "validation_end": F.lit("1999-01-01"),
        "test_end": F.when(k != 0, "2001-01-01"),
    }
    tags = F.map_filter(F.create_map(*[c for n, v in values.items() for c in (F.lit(n), v)]), lambda _, v: v.isNotNull())
    problems = CMP.lineage_problems(tags, C.LINEAGE_KEYS)
    return V.table(spark, sf, "customer").select("c_custkey", F.array_join(problems, "|").alias("problems"))
