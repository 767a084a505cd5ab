"""Drift, scorecard, detectors, decisions, replay, monitoring and experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from underwrite import config as C
from underwrite.functions import calendar as cal
from underwrite.functions import decisions as DC
from underwrite.functions import scoring as S
from underwrite.functions import stats as ST
from underwrite.functions.parsing import dec
from underwrite.operators import binning as B
from underwrite.operators import detectors as DT
from underwrite.operators import drift as DR
from underwrite.operators import experiment as E
from underwrite.operators import explain as X
from underwrite.operators import models as ML
from underwrite.operators import monitoring as MO
from underwrite.operators import replay as R
from underwrite.operators.bootstrap import auc_difference
from underwrite.operators.loans import keep_first
from underwrite.operators.metrics import classification_report
from underwrite.operators.preprocessing import long_numeric
from underwrite.operators.quantiles import exact_quantiles
from underwrite.operators.scan import next_value, with_range
from underwrite.operators.scorecard import Scorecard, points_of_bins
from underwrite.plans import oracles as O
from underwrite.plans import views as V
from underwrite.plans.q_loans import CATS, NUMS, SPEC, canonical, day, features, payloads, silver, written_features
from underwrite.plans.registry import register, rounded
from underwrite.session import materialize
from underwrite.sources import tables

LINES = V.oracle(V.SCORED_LINES)
LOANS = V.oracle(V.SCORED_LOANS)
LOG = V.oracle(V.INFERENCE_LOG)
OUT = V.oracle(V.OUTCOMES)
CLOCK = "2024-01-25 00:00:00"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return V.view(spark, sf, V.SCORED_LINES)


def loans(spark: SparkSession, sf: str) -> DataFrame:
    return V.view(spark, sf, V.SCORED_LOANS)


def log(spark: SparkSession, sf: str) -> DataFrame:
    return V.view(spark, sf, V.INFERENCE_LOG)


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return V.view(spark, sf, V.OUTCOMES)


def stamp(text: str):
    return F.lit(text).cast("timestamp")


# --- C: joins ------------------------------------------------------------------------------------
@register(
    "c01_delayed_labels",
    f"select l.request_id, l.probability, o.actual_default from ({LOG}) l join ({OUT}) o on l.request_id = o.request_id "
    f"where l.source = 'replay' and l.variant = 'champion' and l.model_version = '1' and l.event_ts between timestamp '2024-01-05' and timestamp '2024-01-22' "
    f"and o.observed_ts <= timestamp '{CLOCK}'",
)
def delayed_labels(spark, sf):
    wanted = (
        (F.col("source") == "replay")
        & (F.col("variant") == "champion")
        & (F.col("model_version") == "1")
        & F.col("event_ts").between(stamp("2024-01-05"), stamp("2024-01-22"))
    )
    rows = MO.visible_labels(log(spark, sf), outcomes(spark, sf), stamp(CLOCK), wanted)
    return rounded(rows.select("request_id", "probability", "actual_default"))


WOE_LINES = (
    "g as (select l_returnflag as flag, count(*) filter (where l_linestatus = 'O') as good, count(*) filter (where l_linestatus = 'F') as bad from lineitem group by 1), "
    "w as (select flag, ln(((good + 0.5) / (sum(good) over () + 0.5 * count(*) over ())) / ((bad + 0.5) / (sum(bad) over () + 0.5 * count(*) over ()))) as woe from g)"
)


@register(
    "c02_fitted_value_lookup",
    f"with {WOE_LINES} select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, coalesce(woe, 0) as woe from lineitem left join w on flag = l_returnflag and flag <> 'N'",
)
def fitted_value_lookup(spark, sf):
    rows = V.table(spark, sf, "lineitem")
    y = (F.col("l_linestatus") == "F").cast("bigint")
    coded = rows.groupBy(F.lit("flag").alias("feature"), F.col("l_returnflag").alias("code")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"), F.count(F.lit(1)).alias("n")
    )
    # One row per flag value; a value never fitted keeps the default.
    woe = B.weight_of_evidence(coded).filter("code <> 'N'").select(F.col("code").alias("l_returnflag"), "woe")
    looked = rows.join(F.broadcast(woe), "l_returnflag", "left").withColumn("woe", F.coalesce("woe", dec(0)))
    return rounded(looked.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "woe"))


@register(
    "c05_latest_per_key",
    "select user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1",
)
def latest_per_key(spark, sf):
    rows = V.table(spark, sf, "events").select("user_id", "ts", "event_id")
    newest = MO.latest_row(rows, ["user_id"], "ts")
    return newest.select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@register("c07_interval_assignment", f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, {O.digitize('l_quantity', [5, 10, 20, 35])} as code from lineitem")
def interval_assignment(spark, sf):
    code = S.digitize(F.col("l_quantity"), [5, 10, 20, 35])
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", code.alias("code"))


@register(
    "c08_latest_run_rows",
    "select event_id, event_type from events where cast(ts as date) = (select max(cast(ts as date)) from events)",
)
def latest_run_rows(spark, sf):
    e = V.table(spark, sf, "events")
    text = "select event_id, event_type from {e} where cast(ts as date) = (select max(cast(ts as date)) from {e})"
    return spark.sql(text, e=e)


@register(
    "c09_since_first_challenger",
    f"with l as ({LOG}) select request_id, variant from l where event_ts >= (select min(event_ts) from l where variant = 'challenger')",
)
def since_first_challenger(spark, sf):
    rows = log(spark, sf)
    started = rows.filter("variant = 'challenger'").agg(F.min("event_ts").alias("m")).scalar()
    return rows.withColumn("_s", started).filter("event_ts >= _s").select("request_id", "variant")


# --- D9-D14: profiles and drift ------------------------------------------------------------------
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount"]
TEXTS = ["l_returnflag", "l_linestatus"]
OLD, NEW = "l_shipdate < timestamp '1998-07-01'", "l_shipdate >= timestamp '1998-07-01'"
DECILES = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"
LONG_OLD = " union all ".join(f"select '{c}' as feature, {c} as value from lineitem where {OLD}" for c in NUMERIC)
LONG_NEW = " union all ".join(f"select '{c}' as feature, {c} as value from lineitem where {NEW}" for c in NUMERIC)
PROFILE = (
    f"o as ({LONG_OLD}), n as ({LONG_NEW}), ed as (select feature, list_sort(list_distinct(quantile_cont(value, {DECILES}))) as edges from o group by 1), "
    "ob as (select o.feature, len(list_filter(edges, lambda e: e <= value)) as bin, count(*) as n from o join ed on o.feature = ed.feature group by all), "
    "os as (select feature, cast(bin as varchar) as bin, n / sum(n) over (partition by feature) as share from ob)"
)


def old_and_new(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    cut = stamp("1998-07-01")
    rows = V.table(spark, sf, "lineitem")
    return rows.filter(F.col("l_shipdate") < cut), rows.filter(F.col("l_shipdate") >= cut)


@register("d09_numeric_profile", f"with {PROFILE} select os.feature, os.bin, share, mean, 0.0e0 as null_rate, len(edges) as n_edges from os "
          "join ed on os.feature = ed.feature join (select feature, avg(value) as mean from o group by 1) m on m.feature = os.feature")
def numeric_profile(spark, sf):
    profile = DR.numeric_profile(old_and_new(spark, sf)[0], NUMERIC)
    bins = profile.select(
        "feature", F.posexplode("proportions").alias("bin", "share"), "mean", "null_rate", F.size("edges").cast("bigint").alias("n_edges")
    )
    return rounded(bins.filter("share > 0").withColumn("bin", F.col("bin").cast("string")))


@register(
    "d09_profile_sample",
    " union all ".join(f"select '{c}' as feature, sum({c}) as total, count({c}) as n, count(distinct {c}) as n_values from ({LOANS})" for c in ("p_a", "p_b")),
)
def profile_sample(spark, sf):
    """The reference side of the two-sample distance: counts of all rows, no sample of them."""
    known = DR.profile_counts(loans(spark, sf), ["p_a", "p_b"]).filter(F.col("value").isNotNull())
    facts = known.groupBy("feature").agg(
        F.sum(F.col("value") * F.col("n")).alias("total"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_values")
    )
    return rounded(facts)


def cat_profile_sql(source: str, columns: list[str], limit: float) -> str:
    parts = [
        f"select '{c}' as feature, coalesce({c}, '__missing__') as value, count(*) * 1.0 / (select count(*) from {source}) as share from {source} group by 2"
        for c in columns
    ]
    return (
        f"cs as ({' union all '.join(parts)}), cp as (select feature, case when share >= {limit} then value else '__other__' end as bin, sum(share) as share from cs group by all)"
    )


@register("d10_categorical_profile", f"with {O.features()}, {cat_profile_sql('features', ['purpose', 'addr_state', 'sub_grade'], 0.03)} select * from cp where share > 0")
def categorical_profile(spark, sf):
    profile = DR.categorical_profile(features(spark, sf), ["purpose", "addr_state", "sub_grade"], 0.03)
    return rounded(DR.profile_bins(profile).filter("share > 0"))


PSI = "(greatest(a, 1e-6) - greatest(e, 1e-6)) * ln(greatest(a, 1e-6) / greatest(e, 1e-6))"


@register(
    "d11_stability_index",
    "with oc as (select c_mktsegment as seg, o_orderpriority as bin, o_orderdate < timestamp '1998-01-01' as old, count(*) as n from orders join customer on o_custkey = c_custkey "
    "where o_orderdate < timestamp '1998-01-01' or o_orderpriority <> '1-URGENT' group by all), e as (select seg, bin, n / sum(n) over (partition by seg) as share from oc where old), "
    "a as (select seg, bin, n / sum(n) over (partition by seg) as share from oc where not old), "
    "j as (select coalesce(e.seg, a.seg) as seg, coalesce(e.share, 0) as e, coalesce(a.share, 0) as a from e full join a on e.seg = a.seg and e.bin = a.bin) "
    f"select seg, sum({PSI}) as psi from j group by seg",
)
def stability_index(spark, sf):
    rows = V.table(spark, sf, "orders").join(V.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cut = stamp("1998-01-01")

    def shares(df: DataFrame) -> DataFrame:
        counts = df.groupBy(F.col("c_mktsegment").alias("seg"), F.col("o_orderpriority").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        totals = counts.groupBy("seg").agg(F.sum("n").alias("t"))
        return counts.join(totals, "seg").select("seg", "bin", (F.col("n") / F.col("t").cast("double")).alias("share"))

    new = rows.filter((F.col("o_orderdate") >= cut) & (F.col("o_orderpriority") != "1-URGENT"))
    return rounded(DR.psi(shares(rows.filter(F.col("o_orderdate") < cut)), shares(new), ["seg"]))


KS_SQL = (
    "kc as (select feature, value, count(*) filter (where side = 0) as a, count(*) filter (where side = 1) as b from (select 0 as side, * from o union all select 1, * from n) group by all), "
    "kr as (select feature, sum(a) over w / sum(a) over (partition by feature) as fa, sum(b) over w / sum(b) over (partition by feature) as fb, sum(a) over (partition by feature) as n1, sum(b) over (partition by feature) as n2 "
    "from kc window w as (partition by feature order by value)), ks as (select feature, max(abs(fa - fb)) as ks_statistic, max(n1)::bigint as n1, max(n2)::bigint as n2 from kr group by 1), "
    # exact law of small samples: values arrive one by one, states that reach the distance go no further
    "kx as (with recursive walk as (select feature, least(n1, n2) as n, n1 + n2 as size, round(ks_statistic * n1 * n2)::bigint as lim, 0::bigint as t, 0::bigint as x, 1.0e0 as w "
    "from ks where greatest(n1, n2) <= 10000 union all select feature, n, size, lim, t + 1, x + k, sum(w * (case k when 1 then n - x else size - n - t + x end) / (size - t)) "
    "from walk, (values (0), (1)) s(k) where t < size and abs(x * size - t * n) < lim and (case k when 1 then n - x else size - n - t + x end) > 0 group by feature, n, size, lim, t + 1, x + k) "
    "select feature, least(1.0e0, coalesce(sum(w) filter (where abs(x * size - t * n) >= lim), 0)) as p from walk group by 1)"
)
KS_P = (
    "case when greatest(n1, n2) <= 10000 then (select kx.p from kx where kx.feature = ks.feature) when sqrt(n1 * n2 * 1.0 / (n1 + n2)) * ks_statistic < 0.2 then 1.0 else greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101), lambda k: "
    "case when k % 2 = 1 then 1 else -1 end * exp(-2.0 * k * k * ks_statistic * ks_statistic * n1 * n2 / (n1 + n2)))))) end"
)


@register("d12_two_sample_ks", f"with o as ({LONG_OLD}), n as ({LONG_NEW}), {KS_SQL} select * from ks")
def two_sample_ks(spark, sf):
    old, new = old_and_new(spark, sf)
    return rounded(DR.two_sample_ks(long_numeric(old, NUMERIC), long_numeric(new, NUMERIC), ["feature"], "value"))


@register("d13_ks_p_value", f"with o as ({LONG_OLD}), n as ({LONG_NEW}), {KS_SQL}, p as (select feature, {KS_P} as ks_pvalue from ks) select *, ks_pvalue < 0.01 as ks_drift from p")
def ks_p_value(spark, sf):
    old, new = old_and_new(spark, sf)
    ks = DR.two_sample_ks(long_numeric(old, NUMERIC), long_numeric(new, NUMERIC), ["feature"], "value")
    p = ks.select("feature", ST.ks_p_value("ks_statistic", "n1", "n2").alias("ks_pvalue"))
    return rounded(p.withColumn("ks_drift", F.col("ks_pvalue") < 0.01))


def _drift_sql() -> str:
    cats_old = " union all ".join(f"select '{c}' as feature, {c} as bin, count(*) as n from lineitem where {OLD} group by 2" for c in TEXTS)
    cats_new = " union all ".join(f"select '{c}' as feature, {c} as bin, count(*) as n from lineitem where {NEW} group by 2" for c in TEXTS)
    return (
        f"{PROFILE}, {KS_SQL}, nb as (select n.feature, cast(len(list_filter(edges, lambda e: e <= value)) as varchar) as bin, count(*) as n from n join ed on n.feature = ed.feature group by all), "
        f"co as ({cats_old}), cn as ({cats_new}), ns as (select feature, bin, n / sum(n) over (partition by feature) as share from (select * from nb union all select * from cn)), "
        "es as (select * from os union all select feature, bin, n / sum(n) over (partition by feature) as share from co), "
        "j as (select coalesce(es.feature, ns.feature) as feature, coalesce(es.share, 0) as e, coalesce(ns.share, 0) as a from es full join ns on es.feature = ns.feature and es.bin = ns.bin), "
        f"ps as (select feature, sum({PSI}) as psi from j group by 1), "
        "mo as (select feature, avg(value) as mean_ref from o group by 1), mn as (select feature, avg(value) as mean_cur from n group by 1), "
        "dr as (select case when ps.feature = 'l_discount' then 'prediction' else ps.feature end as feature, case when ks.feature is null then 'categorical' else 'numeric' end as kind, psi, "
        f"ks_statistic, case when ks.feature is not null then {KS_P} end as ks_pvalue, mean_ref, mean_cur from ps left join ks on ps.feature = ks.feature left join mo on ps.feature = mo.feature "
        "left join mn on ps.feature = mn.feature), drift as (select feature, kind, psi, ks_statistic, ks_pvalue, coalesce(ks_pvalue < 0.01, false) as ks_drift, 0.0e0 as null_rate_ref, 0.0e0 as null_rate_cur, "
        "mean_ref, mean_cur, case when psi >= 0.25 then 'alerta' when psi >= 0.1 then 'warning' else 'estable' end as status from dr)"
    )


def profile_of_lines(old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profile and counts of the older lines; the discount plays the part of the score."""
    counts = DR.profile_counts(old, NUMERIC[:2], "l_discount")
    return materialize(DR.reference_profile(old, NUMERIC[:2], TEXTS, "l_discount", counts=counts), "profile"), counts


def drift_table(spark: SparkSession, sf: str) -> DataFrame:
    """All line features against their profile."""
    old, new = old_and_new(spark, sf)
    return DR.feature_drift(*profile_of_lines(old), new, "l_discount")


@register("d14_feature_drift", f"with {_drift_sql()} select * from drift")
def feature_drift(spark, sf):
    return rounded(drift_table(spark, sf))


@register(
    "c03_profile_matched_on_feature",
    f"with {_drift_sql()} select feature, psi from drift where kind = 'numeric'",
)
def profile_matched(spark, sf):
    """Features of the profile the current rows lack are left out."""
    old, new = old_and_new(spark, sf)
    return rounded(DR.feature_drift(*profile_of_lines(old), new.drop(*TEXTS), "l_discount").select("feature", "psi"))


# --- D15-D23: binning and scorecard --------------------------------------------------------------
BIN_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]


def labelled_lines(spark: SparkSession, sf: str) -> DataFrame:
    y = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0)
    # Quantities divisible by nine count as unknown, so that the missing bin exists.
    quantity = F.when(F.col("l_quantity") % 9 != 0, F.col("l_quantity"))
    supp = F.floor(F.sqrt("l_quantity")).cast("string")
    return V.table(spark, sf, "lineitem").withColumns({"y": y, "supp": supp, "l_quantity": quantity})


LABELLED = (
    "ll as (select case l_returnflag when 'R' then 1 when 'A' then 0 end as y, case when l_quantity % 9 <> 0 then l_quantity end as l_quantity, "
    "l_extendedprice, l_discount, l_linestatus, cast(cast(floor(sqrt(l_quantity)) as int) as varchar) as supp from lineitem where l_returnflag in ('R', 'A'))"
)


def _edges_sql() -> str:
    parts = []
    for c in BIN_COLUMNS:
        parts.append(
            f"select '{c}' as feature, case when (select count(distinct {c}) from ll) <= 30 then (select list(m order by m) from (select ({c} + lead({c}) over (order by {c})) / 2.0 as m from "
            f"(select distinct {c} from ll where {c} is not null)) where m is not null) else (select list_sort(list_distinct(list((q + nx) / 2.0))) from (select q, (select min({c}) from ll where {c} > q) as nx "
            f"from (select unnest(quantile_cont({c}, {DECILES})) as q from ll)) where nx is not null) end as edges"
        )
    return " union all ".join(parts)


@register("d15_candidate_edges", f"with {LABELLED}, e as ({_edges_sql()}) select feature, pos, edges[pos] as edge from (select feature, edges, unnest(range(1, len(edges) + 1)) as pos from e)")
def candidate_edges(spark, sf):
    edges = B.candidate_edges(materialize(B.labelled_counts(labelled_lines(spark, sf), "y", BIN_COLUMNS), "counts"))
    listed = edges.select("feature", F.posexplode("edges").alias("pos", "edge"))
    return rounded(listed.withColumn("pos", (F.col("pos") + 1).cast("bigint")))


@register("w08_neighbour_midpoints", "select l_quantity, (l_quantity + lead(l_quantity) over (order by l_quantity)) / 2.0 as edge from (select distinct l_quantity from lineitem) qualify edge is not null")
def neighbour_midpoints(spark, sf):
    values = B.labelled_counts(V.table(spark, sf, "lineitem").withColumn("y", F.lit(1)), "y", ["l_quantity"]).filter(F.col("value").isNotNull())
    pairs = next_value(with_range(values, ["value"], grouped=True), ["feature"], "value", "above").filter(F.col("above").isNotNull())
    return rounded(pairs.select(F.col("value").alias("l_quantity"), ((F.col("value") + F.col("above")) / dec(2)).alias("edge")))


def merged_sql(edges: str, min_share: float) -> str:
    """CTEs up to ``mg`` (feature, edges): the smallest bin joins its smaller neighbour, one step per recursion."""
    values = " union all ".join(f"select '{c}' as feature, {c} as value from ll where {c} is not null" for c in BIN_COLUMNS)
    return (
        f"{edges} as ({_edges_sql()}), mv as ({values}), mc as (select v.feature, len(list_filter(edges, lambda x: x <= value)) as code, count(*) as n from mv v join {edges} using (feature) group by all), "
        f"ma as (select feature, code, edges[code + 1] as edge from (select feature, edges, unnest(range(0, len(edges) + 1)) as code from {edges})), "
        f"mb as (select feature, list({{'n': coalesce(n, 0), 'edge': edge}} order by code) as bins, sum(n) * {min_share!r}::double as minimum from ma left join mc using (feature, code) group by feature), "
        "mr as (select feature, 0 as step, bins, minimum from mb union all select feature, step + 1, "
        "bins[1:f - 1] || [{'n': bins[f].n + bins[f + 1].n, 'edge': bins[f + 1].edge}] || bins[f + 2:], minimum from "
        "(select *, case when spot > 1 and (spot = len(bins) or bins[spot - 1].n <= bins[spot + 1].n) then spot - 1 else spot end as f from "
        "(select *, list_position(list_transform(bins, lambda b: b.n), list_min(list_transform(bins, lambda b: b.n))) as spot from mr "
        "where len(bins) > 1 and list_min(list_transform(bins, lambda b: b.n)) < minimum))), "
        "mg as (select feature, list_filter(list_transform(arg_max(bins, step), lambda b: b.edge), lambda x: x is not null) as edges from mr group by feature)"
    )


@register(
    "d16_merged_bins",
    f"with recursive {LABELLED}, {merged_sql('e', 0.06)} select feature, pos - 1 as pos, edges[pos] as edge from (select feature, edges, unnest(range(1, len(edges) + 1)) as pos from mg)",
)
def merged_bins(spark, sf):
    """Edges after merging neighbours of bins under 6 % of the rows."""
    counts = materialize(B.labelled_counts(labelled_lines(spark, sf), "y", BIN_COLUMNS), "counts")
    merged = B.merge_small_bins(counts, B.candidate_edges(counts), 0.06)
    return rounded(merged.select("feature", F.posexplode("edges").alias("pos", "edge")))


def woe_sql(source: str) -> str:
    """CTE ``woe`` over a CTE with (feature, code, y) rows."""
    return (
        f"wc as (select feature, code, count(*) filter (where y = 1) as pos, count(*) filter (where y = 0) as neg, count(*) as n from {source} group by all), "
        "wt as (select *, (neg + 0.5) / (sum(neg) over f + 0.5 * count(*) over f) as dg, (pos + 0.5) / (sum(pos) over f + 0.5 * count(*) over f) as db, n / sum(n) over f as share "
        "from wc window f as (partition by feature)), woe as (select feature, code, n, share, pos / (pos + neg) as bad_rate, ln(dg / db) as woe, (dg - db) * ln(dg / db) as iv_contribution from wt)"
    )


CAT_CODES = (
    "lv as (select list(supp order by supp) || ['__otros__'] as levels from (select supp from ll group by supp having count(*) >= 0.05 * (select count(*) from ll))), "
    "cc as (select 'supp' as feature, case when list_position(levels, supp) > 0 then list_position(levels, supp) - 1 else len(levels) - 1 end as code, y from ll, lv)"
)


@register("d17_categorical_bins", f"with {LABELLED}, {CAT_CODES} select code, count(*) as n, sum(y)::bigint as pos from cc group by code")
def categorical_bins(spark, sf):
    rows = labelled_lines(spark, sf)
    counts = B.categorical_counts(rows, "y", ["supp"])
    coded = B.categorical_codes(counts, B.categorical_levels(counts, 0.05))
    return coded.select("code", "n", "pos")


NUM_CODES = (
    f"e as ({_edges_sql()}), nc as ("
    + " union all ".join(
        f"select '{c}' as feature, case when {c} is null then 9999 else len(list_filter((select edges from e where feature = '{c}'), lambda v: v <= {c})) end as code, y from ll" for c in BIN_COLUMNS
    )
    + ")"
)


@register("d18_weight_of_evidence", f"with {LABELLED}, {NUM_CODES}, {woe_sql('nc')} select * from woe")
def weight_of_evidence(spark, sf):
    counts = materialize(B.labelled_counts(labelled_lines(spark, sf), "y", BIN_COLUMNS), "counts")
    woe = B.weight_of_evidence(B.numeric_codes(counts, B.candidate_edges(counts)))
    return rounded(woe)


STRENGTH = "case when iv < 0.02 then 'inútil' when iv < 0.1 then 'débil' when iv < 0.3 then 'medio' when iv < 0.5 then 'fuerte' else 'muy alto (> 0.5: verificar posible fuga)' end"


@register("d19_information_value", f"with {LABELLED}, {CAT_CODES}, {NUM_CODES}, u as (select * from nc union all select * from cc), {woe_sql('u')}, t as (select feature, sum(iv_contribution) as iv, count(*) as n_bins from woe group by 1) select feature, iv, {STRENGTH} as strength, n_bins from t")
def information_value(spark, sf):
    rows = labelled_lines(spark, sf)
    counts = materialize(B.labelled_counts(rows, "y", BIN_COLUMNS), "counts")
    texts = B.categorical_counts(rows, "y", ["supp"])
    coded = B.numeric_codes(counts, B.candidate_edges(counts)).unionByName(
        B.categorical_codes(texts, B.categorical_levels(texts, 0.05))
    )
    return rounded(B.iv_table(B.weight_of_evidence(coded)))


@register("d20_bin_labels")
def bin_labels(spark, sf):
    rows = labelled_lines(spark, sf)
    bins = B.fit_bins(rows, "y", BIN_COLUMNS, ["supp"])
    label = B.bin_label(F.col("code"), F.col("edges"), F.col("levels"))
    return bins.select("feature", "code", label.alias("bin"), "n")


SCORE_NUMERIC = ["loan_amnt", "annual_inc", "dti", "fico_score", "loan_to_income"]
SCORE_TEXT = ["purpose", "grade"]


@register("d21_scorecard_fit")
def scorecard_fit(spark, sf):
    card = Scorecard(SCORE_NUMERIC, SCORE_TEXT).fit(written_features(spark, sf), SPEC.target)
    rows = [("(intercept)", card.intercept)] + list(card.coefficients.items())
    return rounded(spark.createDataFrame(rows, "feature string, coefficient double"))


@register("d22_points_per_bin")
def points_per_bin(spark, sf):
    rows = written_features(spark, sf)
    return rounded(Scorecard(SCORE_NUMERIC, SCORE_TEXT).fit(rows, SPEC.target).points_table(rows))


@register(
    "d22_points_of_coefficient",
    f"with {LABELLED}, {NUM_CODES}, {woe_sql('nc')} select feature, code, -(0.8 * woe - 0.25 / 3) * {S.point_factor()!r} + {S.point_offset()!r} / 3 as points from woe",
)
def points_of_coefficient(spark, sf):
    counts = materialize(B.labelled_counts(labelled_lines(spark, sf), "y", BIN_COLUMNS), "counts")
    edges = B.candidate_edges(counts)
    woe = B.weight_of_evidence(B.numeric_codes(counts, edges)).join(F.broadcast(edges), "feature")
    points = points_of_bins(woe.withColumn("levels", F.lit(None).cast("array<string>")), dec(0.8), -0.25, 3)
    return rounded(points.select("feature", "code", "points"))


@register("d23_scorecard_scores")
def scorecard_scores(spark, sf):
    rows = written_features(spark, sf)
    card = Scorecard(SCORE_NUMERIC, SCORE_TEXT).fit(rows, SPEC.target)
    return rounded(rows.select("loan_id", card.probability().alias("pd"), card.points().alias("points")))


# --- W5, W6: detectors ---------------------------------------------------------------------------
DDM_SQL = (
    "s as (select k, x, row_number() over w as n, avg(x) over w as p from src window w as (partition by k order by ts, id)), "
    "l as (select *, sqrt(p * (1 - p) / n) as sd from s), b as (select *, n >= 100 and sd > 0 as act from l), "
    "m as (select *, min(case when act then {'level': p + sd, 'at': n, 'sd': sd} end) over (partition by k order by n) as best from b), "
    "d as (select k, min(n - 1) filter (where act and p + sd > best.level + 2 * best.sd) as di, min(n - 1) filter (where act and p + sd > best.level + best.sd) as wi from m group by k), "
    "ddm as (select d.k, case when di is not null then 'drift' when wi is not null then 'warning' else 'estable' end as state, coalesce(di, wi) as index, "
    "(select arg_max(best.level, n) from m where m.k = d.k and (di is null or n <= di + 1)) as min_p_plus_s from d)"
)


@register(
    "w05_ddm",
    f"with src as (select 0 as k, ts, event_id as id, case when event_type = 'error' then 1.0e0 else 0.0e0 end as x from events), {DDM_SQL} select state, index, min_p_plus_s from ddm",
)
def ddm(spark, sf):
    error = (F.col("event_type") == "error").cast("double")
    return rounded(DT.ddm(V.table(spark, sf, "events"), error, ["ts", "event_id"]))


@register(
    "w05_ddm_per_key",
    f"with src as (select l_linenumber as k, l_shipdate as ts, l_orderkey * 1000000 + l_partkey * 100 + l_suppkey as id, case when l_returnflag = 'R' then 1.0e0 else 0.0e0 end as x from lineitem), {DDM_SQL} "
    "select k as l_linenumber, state, index, min_p_plus_s from ddm",
)
def ddm_per_key(spark, sf):
    """Day-granular times: most of the order within a key comes from the id."""
    error = (F.col("l_returnflag") == "R").cast("double")
    id_ = F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey")
    return rounded(DT.ddm(V.table(spark, sf, "lineitem"), error, ["l_shipdate", id_], ["l_linenumber"]))


PH_SQL = (
    "s as (select k, x, n, avg(x) over (partition by k order by n) as mean from (select *, row_number() over (partition by k order by ts, id) as n from src)), "
    "c as (select *, sum(x - mean - 0.005) over (partition by k order by n) as cum from s), "
    "st as (select *, cum - least(0, min(cum) over (partition by k order by n)) as stat from c), "
    "ph as (select k, bool_or(stat > 50) as drift, min(n - 1) filter (where stat > 50) as index, coalesce(arg_min(stat, n) filter (where stat > 50), arg_max(stat, n)) as statistic from st group by k)"
)


@register(
    "w06_page_hinkley",
    f"with src as (select event_type as k, ts, event_id as id, value / 50 as x from events union all select 'all', ts, event_id, value / 50 from events), {PH_SQL} select drift, index, statistic from ph where k = 'all'",
)
def page_hinkley(spark, sf):
    return rounded(DT.page_hinkley(V.table(spark, sf, "events"), F.col("value") / 50, ["ts", "event_id"]))


@register(
    "w06_page_hinkley_per_key",
    f"with src as (select event_type as k, ts, event_id as id, value / 50 as x from events), {PH_SQL} select k as event_type, drift, index, statistic from ph",
)
def page_hinkley_per_key(spark, sf):
    events = V.table(spark, sf, "events")
    return rounded(DT.page_hinkley(events, F.col("value") / 50, ["ts", "event_id"], ["event_type"]))


# --- D52, D53, D59, D60, O1-O4, U1-U3 ------------------------------------------------------------
@register(
    "d52_clock_lookups",
    f"select source, strftime(min(event_ts), '%Y-%m-%d %H:%M:%S.%f') as first_ts, strftime(max(event_ts), '%Y-%m-%d %H:%M:%S.%f') as last_ts, cast(cast(date_trunc('month', max(event_ts)) as date) as varchar) as clock from ({LOG}) group by source",
)
def clock_lookups(spark, sf):
    micros = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    rows = log(spark, sf).groupBy("source").agg(F.min("event_ts").alias("a"), F.max("event_ts").alias("b"))
    return rows.select(
        "source",
        F.date_format("a", micros).alias("first_ts"),
        F.date_format("b", micros).alias("last_ts"),
        cal.month_start("b").cast("date").cast("string").alias("clock"),
    )


LINEAR = {"l_quantity": (25.5, 14.4, 0.6), "l_discount": (0.05, 0.03, -0.9), "l_tax": (0.04, 0.026, 0.4)}


def line_contributions() -> dict:
    """A fixed linear model over the lines, its tax term split like two dummies of one variable."""
    columns = {"l_quantity": F.col("l_quantity"), "l_discount": F.col("l_discount"), "l_tax": F.col("l_tax"), "l_tax=high": (F.col("l_tax") > 0.06).cast("double")}
    coefficients = {"l_quantity": 0.6, "l_discount": -0.9, "l_tax": 0.4, "l_tax=high": 0.3}
    means = {"l_quantity": 25.5, "l_discount": 0.05, "l_tax": 0.04, "l_tax=high": 0.2}
    spreads = {"l_quantity": 14.4, "l_discount": 0.03, "l_tax": 0.026, "l_tax=high": 0.4}
    return X.linear_contributions(columns, coefficients, means, spreads)


CONTRIB = (
    "ct as (select *, (l_quantity - 25.5) / 14.4 * 0.6 as cq, (l_discount - 0.05) / 0.03 * -0.9 as cd, "
    "(l_tax - 0.04) / 0.026 * 0.4 + (case when l_tax > 0.06 then 1 else 0 end - 0.2) / 0.4 * 0.3 as cx from lineitem)"
)


@register("d53_global_importance", f"with {CONTRIB} select 'l_quantity' as feature, avg(abs(cq)) as mean_abs from ct union all select 'l_discount', avg(abs(cd)) from ct union all select 'l_tax', avg(abs(cx)) from ct")
def global_importance(spark, sf):
    return rounded(X.global_importance(V.table(spark, sf, "lineitem"), line_contributions()))


@register("o03_strongest_variables", f"with {CONTRIB} select * from (select 'l_quantity' as feature, avg(abs(cq)) as mean_abs from ct union all select 'l_discount', avg(abs(cd)) from ct union all select 'l_tax', avg(abs(cx)) from ct) order by mean_abs desc limit 2")
def strongest_variables(spark, sf):
    return rounded(X.global_importance(V.table(spark, sf, "lineitem"), line_contributions(), 2))


@register(
    "m18_linear_contributions",
    digits=5,
    sql=f"with {CONTRIB} select l_orderkey, l_linenumber, l_partkey, l_suppkey, cq as l_quantity, cd as l_discount, cx as l_tax from ct",
)
def linear_contributions(spark, sf):
    keep = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = V.table(spark, sf, "lineitem")
    return rounded(rows.select(*keep, *[c.alias(n) for n, c in line_contributions().items()]), 5)


TOP = (
    "list_sort([{'k': -abs(cq), 'f': 'l_quantity', 'v': cq}, {'k': -abs(cd), 'f': 'l_discount', 'v': cd}, {'k': -abs(cx), 'f': 'l_tax', 'v': cx}])"
)


@register(
    "o02_top_factors",
    digits=4,
    sql=f"with {CONTRIB}, t as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, {TOP} as f from ct) select l_orderkey, l_linenumber, l_partkey, l_suppkey, f[1].f || '|' || f[2].f as features, "
    "(case when f[1].v > 0 then 'aumenta_riesgo' else 'reduce_riesgo' end) as direction, round(f[1].v, 4) as impact from t",
)
def top_factors(spark, sf):
    keep = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    top = X.top_factors(X.factor_array(line_contributions()), {}, 2)
    rows = V.table(spark, sf, "lineitem").select(*keep, top.alias("t"))
    return rounded(
        rows.select(
            *keep,
            F.array_join(F.transform("t", lambda f: f["feature"]), "|").alias("features"),
            F.get("t", F.lit(0))["direction"].alias("direction"),
            F.get("t", F.lit(0))["impact"].alias("impact"),
        ),
        4,
    )


@register(
    "m17_scoring_frame",
    digits=4,
    sql=f"with {CONTRIB}, t as (select *, {TOP} as f, 1 / (1 + exp(-(cq + cd + cx - 1.5))) as p from ct), kinds as (select 'linear' as kind union all select 'tree') "
    f"select kind, l_orderkey, l_linenumber, l_partkey, l_suppkey, p as probability, case when p >= 0.18 then 'RECHAZAR' else 'APROBAR' end as decision, {O.band('p')} as risk_band, 0.18e0 as threshold, "
    "case when kind = 'tree' then '' else f[1].f || '|' || f[2].f || '|' || f[3].f end as features, "
    "case when kind = 'tree' then '' else (case when f[1].v > 0 then 'aumenta_riesgo' else 'reduce_riesgo' end) || '|' || (case when f[2].v > 0 then 'aumenta_riesgo' else 'reduce_riesgo' end) || '|' || (case when f[3].v > 0 then 'aumenta_riesgo' else 'reduce_riesgo' end) end as directions "
    "from t, kinds",
)
def scoring_frame(spark, sf):
    """Batch scoring with given coefficients, and of a model without contributions: the same columns and types."""
    keep = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows, parts = V.table(spark, sf, "lineitem"), line_contributions()
    log_odds = sum(parts.values(), dec(-1.5))
    p = dec(1) / (dec(1) + F.exp(-log_odds))
    frames = [
        ML.scoring_frame(rows, p, contributions, 0.18, {}, keep).select(F.lit(kind).alias("kind"), "*")
        for kind, contributions in (("linear", parts), ("tree", {}))
    ]
    both = frames[0].union(frames[1])
    listed = {name: F.array_join(F.col(f"top_factors.{field}"), "|") for name, field in (("features", "feature"), ("directions", "direction"))}
    return rounded(both.withColumns(listed).drop("top_factors"), 4)


@register(
    "d59_dependence_points",
    digits=4,
    sql=f"with {CONTRIB}, lo as (select 'l_quantity' as feature, l_quantity as value, cq as contribution from ct union all select 'l_discount', l_discount, cd from ct union all select 'l_tax', l_tax, cx from ct), "
    "st as (select feature from lo group by feature order by avg(abs(contribution)) desc, feature limit 2), q as (select feature, quantile_cont(value, 0.99) as top from lo group by feature) "
    "select lo.feature, count(*) as n, sum(value) as total, sum(contribution) as contribution from lo join st on st.feature = lo.feature join q on q.feature = lo.feature where value <= top group by lo.feature",
)
def dependence_points(spark, sf):
    """Points of the two variables that matter most."""
    kept = X.strongest_dependence(V.table(spark, sf, "lineitem"), line_contributions(), ["l_quantity", "l_discount", "l_tax"], 2)
    return rounded(
        kept.groupBy("feature").agg(
            F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.sum("contribution").alias("contribution")
        ),
        4,
    )


MONITORING = (
    "select date_trunc('day', ts) as clock_month, date_trunc('day', ts) + interval 1 hour as run_ts, 'run-' || cast(day(ts) as string) as run_id, "
    "case when day(max(ts)) % 3 = 0 then 'alerta' else 'estable' end as severity, avg(value) / 100 as roc_auc, avg(value) / 500 as prediction_psi, "
    "avg(case when event_type = 'error' then cast(1 as double) else cast(0 as double) end) as default_rate_observed, min(value) as default_rate_predicted, count(*) as features_drifted "
    "from {events} group by date_trunc('day', ts), day(ts)"
)
EXPERIMENTS = (
    "select date_trunc('day', ts) as run_ts, case when day(ts) % 2 = 0 then 'continuar' else 'promover' end as decision, "
    "'dia ' || cast(day(ts) as string) as reason, count(*) as n_champion from {events} group by date_trunc('day', ts), day(ts)"
)
M_SQL, X_SQL = V.oracle(MONITORING), V.oracle(EXPERIMENTS)


@register(
    "d60_kpi_row",
    f"select cast(cast(clock_month as date) as varchar) as clock_month, severity, roc_auc, prediction_psi, default_rate_observed, default_rate_predicted, features_drifted, decision as ab_decision, reason as ab_reason "
    f"from (select * from ({M_SQL}) order by clock_month desc limit 1), (select decision, reason from ({X_SQL}) order by run_ts desc limit 1)",
)
def kpi_row(spark, sf):
    row = MO.monitoring_kpis(V.view(spark, sf, MONITORING), V.view(spark, sf, EXPERIMENTS))
    return rounded(row.withColumn("clock_month", day("clock_month")))


@register("o01_latest_listing", f"select cast(cast(run_ts as date) as varchar) as run_day, decision, reason from ({X_SQL}) order by run_ts desc limit 10")
def latest_listing(spark, sf):
    rows = tables.dashboard(spark, "ab_test_results", ab_test_results=V.view(spark, sf, EXPERIMENTS))
    return rows.select(day("run_ts").alias("run_day"), "decision", "reason")


@register(
    "p14_monitoring_pages",
    f"with m as ({M_SQL}) select 'drift' as page, count(*) as n from events where 'run-' || day(ts) = (select run_id from m order by run_ts desc limit 1) "
    f"union all select 'history', count(*) from m union all select 'experiments', count(*) from (select * from ({X_SQL}) order by run_ts desc limit 10) "
    "union all select 'summary', count(*) from (select * from m order by clock_month desc, run_ts desc limit 36) "
    "union all select 'retrains', count(*) from (select * from m where severity = 'alerta' order by run_ts desc limit 10) "
    "union all select 'benchmark', count(*) from events where date_trunc('hour', ts) = (select max(date_trunc('hour', ts)) from events)",
)
def monitoring_pages(spark, sf):
    monitoring = V.view(spark, sf, MONITORING)
    events = V.table(spark, sf, "events")
    drift = events.select(F.concat(F.lit("run-"), F.day("ts").cast("string")).alias("run_id"))
    hourly = events.select(F.date_trunc("hour", "ts").alias("run_ts"))
    retrains = monitoring.filter("severity = 'alerta'").select(F.col("run_ts").alias("event_ts"))
    pages = {
        "drift": tables.dashboard(spark, "drift_by_feature", drift_by_feature=drift, monitoring_metrics=monitoring),
        "history": tables.dashboard(spark, "monitoring_metrics", monitoring_metrics=monitoring),
        "experiments": tables.dashboard(spark, "ab_test_results", ab_test_results=V.view(spark, sf, EXPERIMENTS)),
        "summary": tables.dashboard(spark, "monitoring_summary", monitoring_metrics=monitoring),
        "retrains": tables.dashboard(spark, "retrain_events", retrain_events=retrains),
        "benchmark": tables.dashboard(spark, "model_benchmark", model_benchmark=hourly),
    }
    out = None
    for name, page in pages.items():
        size = page.agg(F.lit(name).alias("page"), F.count(F.lit(1)).alias("n"))
        out = size if out is None else out.unionByName(size)
    return out


FACTORS = "[{'k': -cq, 'f': 'L_QUANTITY'}, {'k': -cd, 'f': 'L_DISCOUNT'}, {'k': -cx, 'f': 'L_TAX'}]"


@register(
    "o04_reason_codes",
    f"with {CONTRIB} select l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string((['PD_SOBRE_UMBRAL'] || list_transform(list_sort(list_filter({FACTORS}, lambda s: s.k < 0)), lambda s: 'RIESGO_' || s.f))[1:3], '|') as reasons from ct where l_quantity >= 25",
)
def reason_codes(spark, sf):
    keep = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    policy = C.CreditPolicy(max_reason_codes=3)
    factors = X.factor_array(line_contributions())
    decided = DC.decide(F.col("l_quantity") / 100, dec(0.25), dec(0), dec(0), dec(0), factors, policy=policy)
    rows = V.table(spark, sf, "lineitem").select(*keep, decided.alias("d")).filter("d.decision = 'RECHAZAR'")
    return rows.select(*keep, F.array_join("d.reasons", "|").alias("reasons"))


@register(
    "u01_variant_union",
    digits=9,
    sql=f"select loan_id, case when {O.bucket('loan_id')} < 0.2 then 'challenger' else 'champion' end as variant, case when {O.bucket('loan_id')} < 0.2 then p_b else p_a end as probability from ({LOANS})",
)
def variant_union(spark, sf):
    """Each variant scored by its own model in one pass instead of a union of groups."""
    rows = loans(spark, sf).withColumn("s", DC.served_variant(DC.assign_variant("loan_id", 0.2), F.col("p_a"), F.col("p_b")))
    return rounded(rows.select("loan_id", "s.variant", "s.probability"), 9)


@register(
    "u02_evidence_union",
    f"with b as (select * from ({LOANS}) where y is not null) select 'validation' as split, 'p_' || (loan_id % 3) as model, avg(p_a) as auc, count(*) as complexity, cast(null as double) as auc_ci_low, "
    "cast(null as double) as auc_ci_high, loan_id % 3 = 0 as selected from b group by loan_id % 3 union all "
    "select 'test', 'p_' || (loan_id % 3), avg(p_b), null, min(p_b), max(p_b), loan_id % 3 = 1 from b group by loan_id % 3",
)
def evidence_union(spark, sf):
    rows = loans(spark, sf).filter("y is not null").withColumn("model", F.concat(F.lit("p_"), (F.col("loan_id") % 3).cast("string")))
    chosen = rows.groupBy("model").agg(F.avg("p_a").alias("auc"), F.count(F.lit(1)).alias("complexity"))
    tested = rows.groupBy("model").agg(F.avg("p_b").alias("auc"), F.min("p_b").alias("ci_low"), F.max("p_b").alias("ci_high"))
    both = tables.evidence_rows(chosen.withColumn("selected", F.col("model") == "p_0"), tested, "p_1")
    return rounded(both.select("split", "model", "auc", "complexity", "auc_ci_low", "auc_ci_high", "selected"))


@register("u03_distinct_values", "select distinct l_quantity, l_discount from lineitem")
def distinct_values(spark, sf):
    return V.table(spark, sf, "lineitem").select("l_quantity", "l_discount").distinct()


# --- P: decisions, replay, monitoring, experiment ------------------------------------------------
POLICY = (
    "pol as (select o_orderkey, case when o_orderkey % 29 = 0 then null else (o_orderkey % 100) / 250.0e0 end as p, case when c_acctbal > 0 then c_acctbal * 12 end as income, "
    "(o_orderkey % 1500) * 1.0e0 as pay, case when o_orderkey % 7 = 0 then null else (o_orderkey % 50) * 1.0e0 end as dti from orders join customer on o_custkey = c_custkey), "
    "rl as (select *, list_filter([case when coalesce(income, 0) > 0 and coalesce(pay, 0) / (income / 12) > 0.4 then 'CUOTA_INGRESO_ALTA' end, case when dti > 45 then 'DTI_ALTO' end], lambda x: x is not null) as r from pol)"
)


def policy_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.table(spark, sf, "orders").join(V.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    return rows.select(
        "o_orderkey",
        F.when(k % 29 != 0, (k % 100) / dec(250)).alias("p"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") * 12).alias("income"),
        (k % 1500).cast("double").alias("pay"),
        F.when(k % 7 != 0, (k % 50).cast("double")).alias("dti"),
    )


@register(
    "p01_policy_decision",
    f"with {POLICY} select o_orderkey, case when p is null then 'REVISION_MANUAL' when len(r) > 0 or p >= 0.18 then 'RECHAZAR' when p >= 0.18::double - 0.02::double then 'REVISION_MANUAL' else 'APROBAR' end as decision, "
    "case when p is null then 'MODELO_NO_DISPONIBLE' when len(r) > 0 then array_to_string(r, '|') when p >= 0.18 then 'PD_SOBRE_UMBRAL' when p >= 0.18::double - 0.02::double then 'PD_ZONA_GRIS' else '' end as reasons, '2026.10-1' as policy_version from rl",
)
def policy_decision(spark, sf):
    decided = policy_rows(spark, sf).select("o_orderkey", DC.decide("p", dec(0.18), "income", "pay", "dti").alias("d"))
    return decided.select("o_orderkey", "d.decision", F.array_join("d.reasons", "|").alias("reasons"), "d.policy_version")


INVARIANT = "case when o_orderkey % 10 = 0 then 1.5 when o_orderkey % 10 = 1 then null else (o_orderkey % 100) / 100.0e0 end"


@register(
    "p02_output_invariants",
    f"with q as (select o_orderkey, {INVARIANT} as p, case when o_orderkey % 8 = 0 then 'A' else null end as band, case when o_orderkey % 6 = 0 then 'APROBAR' when o_orderkey % 6 = 1 then 'RECHAZAR' else 'REVISION_MANUAL' end as d from orders), "
    "u as (select *, coalesce(p between 0 and 1, false) as ok from q) "
    f"select o_orderkey, array_to_string(list_filter([case when not ok then 'pd_out_of_range' end, case when ok and band <> {O.band('p')} then 'band_mismatch' end, "
    "case when ok and d in ('APROBAR', 'RECHAZAR') and (d = 'RECHAZAR') <> (p >= 0.18) then 'decision_mismatch' end], lambda x: x is not null), '|') as codes from u",
)
def output_invariants(spark, sf):
    k = F.col("o_orderkey")
    p = F.when(k % 10 == 0, 1.5).when(k % 10 != 1, (k % 100) / dec(100))
    band = F.when(k % 8 == 0, "A")
    decision = F.when(k % 6 == 0, "APROBAR").when(k % 6 == 1, "RECHAZAR").otherwise("REVISION_MANUAL")
    rows = V.table(spark, sf, "orders").select("o_orderkey", p.alias("p"), band.alias("band"), decision.alias("d"))
    codes = DC.violations(F.col("p"), dec(0.18), F.col("band"), F.col("d"))
    return rows.select("o_orderkey", F.array_join(codes, "|").alias("codes"))


@register(
    "p03_prudent_fallback",
    f"select o_orderkey, case when p is null or p > 1 then 'REVISION_MANUAL' when p >= 0.18 then 'RECHAZAR' when p >= 0.18::double - 0.02::double then 'REVISION_MANUAL' else 'APROBAR' end as decision, "
    "case when p is null then 'MODELO_NO_DISPONIBLE' when p > 1 then 'SALIDA_MODELO_INCOHERENTE' when p >= 0.18 then 'PD_SOBRE_UMBRAL' when p >= 0.18::double - 0.02::double then 'PD_ZONA_GRIS' else '' end as reasons "
    f"from (select o_orderkey, {INVARIANT} as p from orders)",
)
def prudent_fallback(spark, sf):
    k = F.col("o_orderkey")
    p = F.when(k % 10 == 0, 1.5).when(k % 10 != 1, (k % 100) / dec(100))
    rows = V.table(spark, sf, "orders").select("o_orderkey", p.alias("p"))
    decided = rows.select("o_orderkey", DC.decide("p", dec(0.18), dec(0), dec(0), dec(0)).alias("d"))
    return decided.select("o_orderkey", "d.decision", F.array_join("d.reasons", "|").alias("reasons"))


@register("p04_sticky_assignment", digits=9, sql=f"select o_orderkey, case when {O.bucket('o_orderkey')} < 0.2 then 'challenger' else 'champion' end as variant, {O.bucket('o_orderkey')} as bucket from orders")
def sticky_assignment(spark, sf):
    rows = V.table(spark, sf, "orders")
    return rounded(rows.select("o_orderkey", DC.assign_variant("o_orderkey", 0.2).alias("variant"), DC.traffic_bucket("o_orderkey").alias("bucket")), 9)


@register(
    "p07_window_bounds",
    "select cast(cast(m as date) as varchar) as clock, cast(cast(m - interval 2 month as date) as varchar) as drift_start, cast(cast(m as date) as varchar) as drift_end, "
    "cast(cast(m - interval 8 month as date) as varchar) as label_start, cast(cast(m - interval 6 month as date) as varchar) as label_end, n from (select date_trunc('month', o_orderdate) as m, count(*) as n from orders group by 1)",
)
def window_bounds(spark, sf):
    months = V.table(spark, sf, "orders").groupBy(cal.month_start("o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    bounds = months.select("n", F.inline(F.array(cal.monitoring_windows("m", 3, 6))))
    return bounds.select("n", *[day(c).alias(c) for c in ("clock", "drift_start", "drift_end", "label_start", "label_end")])


LABELLED_LOG = f"lb as (select l.*, o.actual_default as y from ({LOG}) l join ({OUT}) o on l.request_id = o.request_id where l.probability is not null and o.observed_ts <= timestamp '{CLOCK}')"
# Pooled z of the window's default rate against 2,000 of 10,000 reference rows.
PRIOR_Z = "((bad / n::double - 0.2) / sqrt((bad + 2000) / (n + 10000)::double * (1 - (bad + 2000) / (n + 10000)::double) * (1 / n::double + 1 / 10000::double)))"
REFERENCE = {"roc_auc": 0.75, "ks": 0.4, "brier": 0.15, "default_rate_observed": 0.20}


CONCEPT_CTES = (
    f"{O.counted('b', 'y', 'probability')}, me as (select {O.AUC} as auc, {O.KS} as ks from r), "
    "ag as (select count(*) as n, sum(y) as bad, avg(y) as observed, avg(probability) as predicted, avg((least(greatest(probability, 1e-7), 1 - 1e-7) - y) ** 2) as brier from b), "
    f"src as (select 0 as k, event_ts as ts, request_id as id, case when (least(greatest(probability, 1e-7), 1 - 1e-7) >= 0.18) <> (y = 1) then 1.0e0 else 0.0e0 end as x from b), {DDM_SQL.replace('s as', 's1 as').replace('from s)', 'from s1)').replace(' l as', ' l1 as').replace('from l)', 'from l1)').replace(' b as', ' b1 as').replace('from b)', 'from b1)').replace(' d as', ' d1 as').replace('d.k', 'd1.k').replace('from d)', 'from d1)')}, "
    "src2 as (select 0 as k, event_ts as ts, request_id as id, -(y * ln(q) + (1 - y) * ln(1 - q)) as x from (select *, least(greatest(probability, 1e-7), 1 - 1e-7) as q from b)), "
    f"{PH_SQL.replace('s as (', 's2 as (').replace('from src)', 'from src2)').replace('from s)', 'from s2)').replace('c as (', 'c2 as (').replace('from c)', 'from c2)')}"
)


@register(
    "p08_concept_report",
    f"with {LABELLED_LOG}, b as (select * from lb), {CONCEPT_CTES} "
    f"select n, bad::bigint as n_pos, 0.75 - auc as auc_drop, 0.4 - ks as ks_drop, brier - 0.15 as brier_increase, predicted - observed as calibration_gap, state as ddm_state, ddm.index as ddm_index, ph.drift as page_hinkley_drift, ph.statistic as page_hinkley_statistic, {PRIOR_Z} as prior_shift_z, "
    f"abs(observed - 0.2) >= 0.03 and abs({PRIOR_Z}) > 1.959963984540054 as prior_shift, "
    "0.75 - auc >= 0.04 or 0.4 - ks >= 0.08 or (state = 'drift' and ph.drift) as concept_drift, "
    "0.75 - auc >= 0.04 as auc_degradation, 0.4 - ks >= 0.08 as ks_degradation, brier - 0.15 >= 0.02 as calibration_degradation from ag, me, ddm, ph",
)
def concept_report(spark, sf):
    rows = MO.visible_labels(log(spark, sf), outcomes(spark, sf), stamp(CLOCK), F.col("probability").isNotNull())
    report = MO.concept_report(rows, "actual_default", "probability", ["event_ts", "request_id"], REFERENCE, 0.18)
    return rounded(
        report.select(
            "n", "n_pos", "auc_drop", "ks_drop", "brier_increase", "calibration_gap", "ddm_state", "ddm_index",
            "page_hinkley_drift", "page_hinkley_statistic", "prior_shift_z", "prior_shift", "concept_drift",
            "auc_degradation", "ks_degradation", "calibration_degradation",
        )
    )


RETRAIN = (
    "select o_custkey, count(*) * 100 as n_rows, avg(o_totalprice) / 1000000 as pred, count(*) % 6 as k, max(o_orderdate) as now, max(o_orderdate) - interval 60 day as recent from orders group by 1"
)


@register(
    "p09_retrain_decision",
    f"with q as ({RETRAIN}), r as (select *, n_rows < 300 as thin, list_filter([case when k >= 3 then 'data drift en ' || k || ' features: ' || array_to_string(['a', 'b', 'c', 'd', 'e'][1:k], ', ') end, "
    "case when pred >= 0.2 then 'prediction drift PSI=' || printf('%.3f', pred) end, case when k = 1 then 'concept drift: auc_degradation' end], lambda x: x is not null) as base from q), "
    "s as (select *, len(base) > 0 and o_custkey % 2 = 0 as cooling from r) select o_custkey, not thin and len(base) > 0 and not cooling as retrain, "
    "case when thin then 'sin_datos' when k = 1 then 'critico' when len(base) > 0 then 'alerta' else 'estable' end as severity, "
    "case when thin then 'ventana con ' || n_rows || ' filas < 300' else array_to_string(base || case when cooling then ['cooldown activo: se registra la alerta pero no se reentrena'] else [] end, '|') end as reasons from s",
)
def retrain_decision(spark, sf):
    rows = V.table(spark, sf, "orders").groupBy("o_custkey").agg(
        (F.count(F.lit(1)) * 100).alias("n_rows"),
        (F.avg("o_totalprice") / 1000000).alias("pred"),
        (F.count(F.lit(1)) % 6).cast("int").alias("k"),
        F.max("o_orderdate").cast("timestamp").alias("now"),
    )
    names = F.slice(F.array(*[F.lit(c) for c in "abcde"]), 1, F.col("k"))
    fired = F.when(F.col("k") == 1, F.array(F.lit("auc_degradation"))).otherwise(F.array().cast("array<string>"))
    last = F.when(F.col("o_custkey") % 2 == 0, F.col("now") - F.expr("INTERVAL 60 DAYS"))
    decision = MO.retrain_decision(F.col("n_rows"), names, F.col("pred"), fired, F.col("k") == 1, last, F.col("now"))
    out = rows.select("o_custkey", decision.alias("d"))
    return out.select("o_custkey", "d.retrain", "d.severity", F.array_join("d.reasons", "|").alias("reasons"))


# Some champion requests come from an older version, and an earlier challenger ran before this one.
ARM_VERSIONS = {"champion": "1", "challenger": "2"}
POPULATION = (
    f"lg as (select * replace (case when variant = 'challenger' and event_ts < timestamp '2024-01-12' then '1' when variant = 'champion' and request_id % 7 = 0 then '0' else model_version end as model_version) from ({LOG})), pop as (select l.variant, l.probability, l.decision, o.actual_default from lg l join ({OUT}) o on l.request_id = o.request_id where o.observed_ts <= timestamp '{CLOCK}' "
    "and l.probability is not null and (l.variant, l.model_version) in (('champion', '1'), ('challenger', '2')) "
    "and l.event_ts >= (select min(event_ts) from lg where variant = 'challenger' and model_version = '2'))"
)


def population(spark: SparkSession, sf: str) -> DataFrame:
    rows = log(spark, sf)
    earlier = (F.col("variant") == "challenger") & (F.col("event_ts") < stamp("2024-01-12"))
    older = (F.col("variant") == "champion") & (F.col("request_id") % 7 == 0)
    version = F.when(earlier, "1").when(older, "0").otherwise(F.col("model_version"))
    return E.comparable_population(rows.withColumn("model_version", version), outcomes(spark, sf), stamp(CLOCK), ARM_VERSIONS)


@register("p13_comparable_population", f"with {POPULATION} select variant, count(*) as n, sum(probability) as total, sum(actual_default)::bigint as bad from pop group by variant")
def comparable_population(spark, sf):
    rows = population(spark, sf)
    return rounded(
        rows.groupBy("variant").agg(
            F.count(F.lit(1)).alias("n"), F.sum("probability").alias("total"), F.sum("actual_default").alias("bad")
        )
    )


@register(
    "p11_arm_aggregates",
    f"with {POPULATION} select variant, count(*) as n, count(*) filter (where decision = 'APROBAR') as approved, avg(case when decision = 'APROBAR' then 1.0 else 0.0 end) as approval_rate, "
    "sum(case when decision = 'APROBAR' then actual_default else 0 end)::bigint as bad_approved, sum(case when decision = 'APROBAR' then actual_default else 0 end) / greatest(count(*) filter (where decision = 'APROBAR'), 1) as bad_rate_approved from pop group by variant",
)
def arm_aggregates(spark, sf):
    return rounded(E.arm_summary(population(spark, sf)))


DIFFERENCE = (
    f"{O.bootstrap('pop', 'actual_default', 'probability', 500, 'variant')}, "
    f"ba as (select variant, r, {O.BOOTSTRAP_METRICS['roc_auc']} as auc from bs group by all), "
    "bf as (select r, max(auc) filter (where variant = 'challenger') - max(auc) filter (where variant = 'champion') as v from ba group by r), "
    "gain as (select max(v) filter (where r = 0) as auc_diff, quantile_cont(v, 0.025) filter (where r > 0) as ci_low, quantile_cont(v, 0.975) filter (where r > 0) as ci_high, "
    "avg((v <= 0)::int) filter (where r > 0) as p_value from bf)"
)


@register("d40_bootstrap_difference", f"with {POPULATION}, {DIFFERENCE} select * from gain")
def bootstrap_difference(spark, sf):
    rows = population(spark, sf)
    return rounded(auc_difference(rows, "actual_default", "probability", "variant", "champion", "challenger", 500))


def _arm(name: str, rule: str) -> str:
    return ", ".join(f"{rule.format(arm=arm)} as {name}_{arm}" for arm in ("champion", "challenger"))


VERDICT_SQL = (
    f"with {POPULATION}, {DIFFERENCE}, {O.counted('pop', 'actual_default', 'probability', 'variant')}, {O.delong('variant')}, "
    "ar as (select variant, count(*) as n, count(*) filter (where decision = 'APROBAR') as approved, sum(case when decision = 'APROBAR' then actual_default else 0 end)::bigint as bad from pop group by variant), "
    f"wide as (select {_arm('n', "max(n) filter (where variant = '{arm}')")}, {_arm('approved', "max(approved) filter (where variant = '{arm}')")}, "
    f"{_arm('approval_rate', "max(approved / n) filter (where variant = '{arm}')")}, {_arm('bad_approved', "max(bad) filter (where variant = '{arm}')")}, "
    f"{_arm('bad_rate_approved', "max(bad / greatest(approved, 1)) filter (where variant = '{arm}')")} from ar), "
    f"aw as (select {_arm('auc', "max(auc) filter (where variant = '{arm}')")} from d), "
    "pz as (select *, (bad_approved_challenger + bad_approved_champion) / (approved_challenger + approved_champion) as pooled from wide, aw, gain), "
    "zz as (select *, case when least(approved_challenger, approved_champion) = 0 then null when pooled in (0, 1) then 0 else (bad_approved_challenger / approved_challenger - bad_approved_champion / approved_champion) "
    "/ sqrt(pooled * (1 - pooled) * (1.0e0 / approved_challenger + 1.0e0 / approved_champion)) end as bad_rate_z from pz), "
    f"tt as (select * exclude (pooled), {O.tail('bad_rate_z')} as bad_rate_pvalue, 1.0e0 as months_running from zz), "
    "hh as (select *, coalesce(bad_rate_z > 0 and bad_rate_pvalue < 0.05, false) as harm from tt) "
    "select * exclude (harm), case when least(n_champion, n_challenger) < 500 then 'continuar' when ci_low > 0 and p_value < 0.05 and not harm then 'promover' when ci_high < 0 or harm or months_running >= 6 then 'detener' else 'continuar' end as decision, "
    "case when least(n_champion, n_challenger) < 500 then 'muestra insuficiente por brazo' when ci_low > 0 and p_value < 0.05 and not harm then 'challenger superior con significancia' when ci_high < 0 or harm then 'challenger inferior o dañino para el negocio' "
    "when months_running >= 6 then 'sin diferencia significativa al cierre del test' else 'aún sin significancia' end as reason from hh"
)


@register("p12_experiment_verdict", VERDICT_SQL)
def experiment_verdict(spark, sf):
    """Full evaluation; its interval comes from bootstrap draws."""
    rows = population(spark, sf)
    return rounded(E.evaluate(rows, dec(1), C.ExperimentRules()))


@register(
    "p12_verdict_rules",
    "with q as (select o_custkey, count(*) * 60 as n, (o_custkey % 21 - 10) / 100.0e0 as mid, (o_custkey % 7) / 100.0e0 as z from orders group by 1), "
    "v as (select *, mid - 0.03 as lo, mid + 0.03 as hi, case when mid > 0.03 then 0.01 else 0.5 end as p, o_custkey % 9 as months, o_custkey % 11 = 0 as harm from q) "
    "select o_custkey, case when n < 500 then 'continuar' when lo > 0 and p < 0.05 and not harm then 'promover' when hi < 0 or harm or months >= 6 then 'detener' else 'continuar' end as decision, "
    "case when n < 500 then 'muestra insuficiente por brazo' when lo > 0 and p < 0.05 and not harm then 'challenger superior con significancia' when hi < 0 or harm then 'challenger inferior o dañino para el negocio' "
    "when months >= 6 then 'sin diferencia significativa al cierre del test' else 'aún sin significancia' end as reason from v",
)
def verdict_rules(spark, sf):
    rows = V.table(spark, sf, "orders").groupBy("o_custkey").agg((F.count(F.lit(1)) * 60).alias("n"))
    k = F.col("o_custkey")
    middle = (k % 21 - 10) / dec(100)
    harm = k % 11 == 0
    v = E.verdict(
        F.col("n"), F.col("n"), middle - 0.03, middle + 0.03, F.when(middle > 0.03, 0.01).otherwise(0.5),
        F.when(harm, 2.0).otherwise(-2.0), F.when(harm, 0.01).otherwise(0.9), (k % 9).cast("double"),
    )
    return rows.select("o_custkey", v.alias("v")).select("o_custkey", "v.*")


@register(
    "p15_variant_fallback",
    digits=9,
    sql=f"with q as (select loan_id, {O.bucket('loan_id')} < 0.5 as ch, case when loan_id % 17 <> 0 then p_a end as pa, case when loan_id % 5 <> 0 then p_b end as pb from ({LOANS})) "
    "select loan_id, case when ch and pb is not null then 'challenger' else 'champion' end as variant, case when ch then coalesce(pb, pa) else pa end as probability, "
    "case when (case when ch then coalesce(pb, pa) else pa end) is null then 'REVISION_MANUAL' else 'ok' end as outcome from q",
)
def variant_fallback(spark, sf):
    rows = loans(spark, sf)
    p_a = F.when(F.col("loan_id") % 17 != 0, F.col("p_a"))
    p_b = F.when(F.col("loan_id") % 5 != 0, F.col("p_b"))
    served = rows.select("loan_id", DC.served_variant(DC.assign_variant("loan_id", 0.5), p_a, p_b).alias("s")).select("loan_id", "s.*")
    decided = DC.decide("probability", dec(0.18), dec(0), dec(0), dec(0))["reasons"]
    outcome = F.when(F.array_contains(decided, C.REASON_NO_MODEL), "REVISION_MANUAL").otherwise("ok")
    return rounded(served.withColumn("outcome", outcome), 9)
