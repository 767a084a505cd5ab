"""Sources, parsing, projections and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from underwrite import config as C
from underwrite.functions import calendar as cal
from underwrite.functions import decisions as dec_
from underwrite.functions import parsing as P
from underwrite.functions import scoring as S
from underwrite.operators import loans as L
from underwrite.operators import preprocessing as PP
from underwrite.operators import quality as Q
from underwrite.plans import oracles as O
from underwrite.plans import views as V
from underwrite.plans.registry import register, rounded
from underwrite.session import materialize, scratch_path
from underwrite.sources import files, tables

SPEC = C.LoanSpec(label_snapshot=O.SNAPSHOT)
RAW = V.oracle(V.RAW_LOANS)


def raw_loans(spark: SparkSession, sf: str) -> DataFrame:
    return V.view(spark, sf, V.RAW_LOANS)


def canonical(spark: SparkSession, sf: str) -> DataFrame:
    return L.parse_loans(raw_loans(spark, sf), SPEC)


def silver(spark: SparkSession, sf: str) -> DataFrame:
    """Typed rows, parsed where they are read: a plan pays for the columns it uses and writes nothing."""
    return canonical(spark, sf)


def features(spark: SparkSession, sf: str) -> DataFrame:
    return L.build_features(L.clean_loans(silver(spark, sf), SPEC), SPEC)


def written_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features written once, for fits that pass over them several times."""
    return materialize(features(spark, sf), "features")


# Cut dates that leave labelled rows in all periods once every loan has matured.
CUTS_ALL = ("1998-01-01", "1999-07-01", "2001-01-01")


def features_at(spark: SparkSession, sf: str, snapshot: str) -> DataFrame:
    """Features with the labels known at another snapshot of the file."""
    spec = C.LoanSpec(label_snapshot=snapshot)
    return L.build_features(L.clean_loans(L.parse_loans(raw_loans(spark, sf), spec), spec), spec)


def day(c: str):
    """A date as text, the same in both engines."""
    return F.col(c).cast("date").cast("string")


def written_csv(spark: SparkSession, sf: str) -> str:
    """The raw loans as a CSV file set in the shared scratch folder."""
    path = scratch_path(spark, "loans-csv")
    keep = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    raw_loans(spark, sf).write.options(header="true", escape='"', **keep).csv(path)
    return path


# --- A: scans, sources, sinks --------------------------------------------------------------------
SOURCES = ", ".join(SPEC.source_columns)


@register("a01_csv_scan", f"select {SOURCES}, total_pymnt from ({RAW}) where true")
def csv_scan(spark, sf):
    raw = files.read_loan_csv(spark, written_csv(spark, sf))
    # An empty quoted text and NULL are the same empty field in a CSV file.
    return raw.select(*SPEC.source_columns, "total_pymnt").withColumn(
        "revol_util", F.coalesce("revol_util", F.lit(""))
    )


@register("a02_whitelist", f"select {SOURCES} from ({RAW})")
def whitelist(spark, sf):
    return files.whitelist(raw_loans(spark, sf), SPEC)


@register("a03_audit_columns", f"select trim(id) as id, 'drop-' || trim(id)::bigint % 3 as dropped_in, true as stamped, loan_amnt, purpose from ({RAW})")
def audit(spark, sf):
    """Three folders of CSV files; every row names the file it was read from."""
    path = scratch_path(spark, "drops")
    rows = raw_loans(spark, sf)
    keep = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    for k in range(3):
        rows.where(F.trim("id").cast("bigint") % 3 == k).write.options(header="true", escape='"', **keep).csv(f"{path}/drop-{k}")
    bronze = files.bronze(files.read_loan_csv(spark, f"{path}/drop-*", rows.columns), None, SPEC)
    folder = F.regexp_extract("source_file", "/(drop-[0-9])/[^/]*[.]csv$", 1)
    return bronze.select(F.trim("id").alias("id"), folder.alias("dropped_in"), F.col("ingested_ts").isNotNull().alias("stamped"), "loan_amnt", "purpose")


@register("a04_overwrite", f"select {SOURCES} from ({RAW})")
def overwrite(spark, sf):
    """A table with leaking columns, replaced with its schema by the allowed ones."""
    table = f"{fresh_database(spark, 'overwritten')}.bronze_loans"
    raw = raw_loans(spark, sf)
    tables.overwrite_table(raw.select("id", "total_pymnt"), table)
    tables.overwrite_table(files.whitelist(raw, SPEC), table)
    return spark.table(table)


@register(
    "a05_tolerant_append",
    f"with log as ({V.oracle(V.OUTCOMES)}) select loan_id, request_id, actual_default, "
    "cast(cast(observed_ts as date) as varchar) as observed_day, cast(null as varchar) as source from log "
    "union all select loan_id, request_id, cast(null as int), cast(null as varchar), 'api' from log "
    "where actual_default = 1",
)
def tolerant_append(spark, sf):
    shape = spark.createDataFrame([], "loan_id string, request_id bigint, actual_default int, observed_ts timestamp, source string")
    path = scratch_path(spark, "append")
    rows = V.view(spark, sf, V.OUTCOMES)
    tables.conform(rows.withColumn("extra", F.lit(1)), shape).write.mode("append").parquet(path)
    later = rows.filter("actual_default = 1").select("request_id", "loan_id", F.lit("api").alias("SOURCE"))
    tables.conform(later, shape).write.mode("append").parquet(path)
    back = spark.read.schema(shape.schema).parquet(path)
    return back.select("loan_id", "request_id", "actual_default", day("observed_ts").alias("observed_day"), "source")


@register("a08_table_or_query", "select l_returnflag, count(*) as n from lineitem group by l_returnflag")
def table_or_query(spark, sf):
    V.table(spark, sf, "lineitem").createOrReplaceTempView("underwrite_lines")
    whole = tables.read(spark, "underwrite_lines")
    whole.createOrReplaceTempView("underwrite_lines_again")
    return tables.read(spark, "select l_returnflag, count(*) as n from underwrite_lines_again group by l_returnflag")


@register(
    "a09_data_version",
    "select cast(2 as bigint) as latest, count(*) filter (where o_orderstatus = 'F') as rows_v1, count(*) as rows_v2 from orders",
)
def data_version(spark, sf):
    path = scratch_path(spark, "versions")
    orders = V.table(spark, sf, "orders")
    tables.write_version(orders.filter("o_orderstatus = 'F'"), path, 1)
    tables.write_version(orders, path, 2)
    latest = tables.table_version(spark, path)
    one = tables.read_version(spark, path, 1).agg(F.count(F.lit(1)).alias("n")).scalar()
    return tables.read_version(spark, path, latest).agg(F.count(F.lit(1)).alias("rows_v2")).select(
        F.lit(latest).cast("bigint").alias("latest"), one.alias("rows_v1"), "rows_v2"
    )


@register(
    "a10_pruned_report_load",
    f"select {SOURCES} from ({RAW}) where try_cast(loan_amnt as double) is not null",
)
def pruned_load(spark, sf):
    raw = files.read_loan_csv(spark, written_csv(spark, sf))
    kept = files.whitelist(raw, SPEC).filter(P.is_loan_row("loan_amnt"))
    return kept.withColumn("revol_util", F.coalesce("revol_util", F.lit("")))


@register(
    "a11_json_export",
    "select 'nation' as \"table\", count(*) as rows from nation union all select 'orders', count(*) from orders",
)
def json_export(spark, sf):
    pages = {n: V.table(spark, sf, n) for n in ("nation", "orders")}
    return files.export_tables(pages, scratch_path(spark, "export"))


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Requests rendered from customers as nested JSON text."""
    key = F.col("c_custkey")
    application = F.struct(
        (F.lit(500) + key % 39000).alias("loan_amnt"),
        F.floor("c_acctbal").alias("annual_inc"),
        F.substring(F.lit("ABCDEFG"), (F.lit(1) + key % 7).cast("int"), F.lit(1)).alias("grade"),
        F.when(key % 10 != 0, (key % 60).cast("double") + 0.5).alias("dti"),
    )
    body = F.struct(
        F.concat(F.lit("L"), key.cast("string")).alias("loan_id"),
        application.alias("application"),
        (key % 2 == 0).alias("explain"),
    )
    return V.table(spark, sf, "customer").select("c_custkey", F.to_json(body).alias("payload"))


@register(
    "a12_request_payload",
    "select c_custkey, 'L' || c_custkey as loan_id, cast(500 + c_custkey % 39000 as double) as loan_amnt, "
    "floor(c_acctbal) as annual_inc, substr('ABCDEFG', 1 + c_custkey % 7, 1) as grade, "
    "case when c_custkey % 10 <> 0 then c_custkey % 60 + 0.5e0 end as dti, c_custkey % 2 = 0 as explain from customer",
)
def request_payload(spark, sf):
    flat = files.flatten_requests(payloads(spark, sf), "payload", ["c_custkey"], SPEC)
    return flat.select("c_custkey", "loan_id", "loan_amnt", "annual_inc", "grade", "dti", "explain")


def fresh_database(spark: SparkSession, name: str) -> str:
    """Operational tables in a database of their own below the scratch folder."""
    path = scratch_path(spark, name)
    database = path.rsplit("/", 1)[1].replace("-", "_")
    tables.ensure_tables(spark, database, path)
    return database


@register(
    "a06_operational_tables",
    f"with log as ({V.oracle(V.INFERENCE_LOG)}) select 'inference_log' as \"table\", count(*) as rows from log "
    f"union all select 'outcomes', count(*) from ({V.oracle(V.OUTCOMES)})",
)
def operational_tables(spark, sf):
    db = fresh_database(spark, "operational")
    tables.append_rows(V.view(spark, sf, V.INFERENCE_LOG), f"{db}.inference_log")
    tables.append_rows(V.view(spark, sf, V.OUTCOMES), f"{db}.outcomes")
    tables.ensure_tables(spark, db)
    sizes = [
        spark.table(f"{db}.{t}").agg(F.lit(t).alias("table"), F.count(F.lit(1)).alias("rows"))
        for t in ("inference_log", "outcomes")
    ]
    return sizes[0].unionByName(sizes[1])


@register(
    "a07_column_migration",
    f"with o as ({V.oracle(V.OUTCOMES)}) select 2 * count(*) as n, count(*) as with_channel, "
    "'channel' as added from o",
)
def column_migration(spark, sf):
    db = fresh_database(spark, "migration")
    table = f"{db}.outcomes"
    rows = V.view(spark, sf, V.OUTCOMES)
    tables.append_rows(rows, table)
    added = tables.ensure_columns(spark, table, {"LOAN_ID": "STRING", "channel": "STRING"})
    again = tables.ensure_columns(spark, table, {"channel": "STRING"})
    tables.append_rows(rows.withColumn("channel", F.lit("web")), table)
    return spark.table(table).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("channel").alias("with_channel"),
        F.lit(",".join([*added, *again])).alias("added"),
    )


# --- B: projections, filters, parsing ------------------------------------------------------------
@register("b01_footer_rows", f"select id from ({RAW}) where try_cast(loan_amnt as double) is not null")
def footer_rows(spark, sf):
    return raw_loans(spark, sf).filter(P.is_loan_row("loan_amnt")).select("id")


@register(
    "b02_number_from_text",
    f"select id, {O.number('int_rate')} as int_rate, {O.number('term')} as term, {O.number('revol_util')} as revol_util, "
    f"{O.number('loan_amnt')} as loan_amnt from ({RAW})",
)
def number_from_text(spark, sf):
    names = ("int_rate", "term", "revol_util", "loan_amnt")
    return raw_loans(spark, sf).select("id", *[P.number_from_text(n).alias(n) for n in names])


@register("b03_month_from_text", f"select id, cast(cast({O.month('issue_d')} as date) as varchar) as month from ({RAW})")
def month_from_text(spark, sf):
    return raw_loans(spark, sf).select("id", P.month_from_text("issue_d").cast("date").cast("string").alias("month"))


STATUS = (
    f"case when trim(loan_status) in {O.text_list(C.POSITIVE_STATUS)} then 1.0e0 "
    f"when trim(loan_status) in {O.text_list(C.NEGATIVE_STATUS)} then 0.0e0 end"
)


@register("b04_three_state_label", f"select id, {STATUS} as label from ({RAW})")
def three_state_label(spark, sf):
    label = P.status_label("loan_status", C.POSITIVE_STATUS, C.NEGATIVE_STATUS)
    return raw_loans(spark, sf).select("id", label.alias("label"))


@register(
    "b05_right_censoring",
    f"with {O.canonical()} select loan_id, target_default from canonical",
)
def right_censoring(spark, sf):
    return canonical(spark, sf).select("loan_id", "target_default")


@register(
    "b06_employment_years",
    f"select id, cast({O.case_map('trim(emp_length)', C.EMPLOYMENT_YEARS)} as double) as years from ({RAW})",
)
def employment_years(spark, sf):
    return raw_loans(spark, sf).select("id", P.employment_years("emp_length").alias("years"))


@register("b07_score_midpoint", f"select id, {O.numeric(C.NUMERIC_FEATURES[8])} as fico_score from ({RAW})")
def score_midpoint(spark, sf):
    mid = P.score_midpoint(P.number_from_text("fico_range_low"), P.number_from_text("fico_range_high"))
    return raw_loans(spark, sf).select("id", mid.alias("fico_score"))


@register(
    "b08_whole_months",
    f"select id, {O.months_between(O.month('earliest_cr_line'), O.month('issue_d'))} as months from ({RAW})",
)
def whole_months(spark, sf):
    months = cal.whole_months(P.month_from_text("earliest_cr_line"), P.month_from_text("issue_d"))
    return raw_loans(spark, sf).select("id", months.cast("bigint").alias("months"))


@register(
    "b09_category_normalisation",
    f"select id, {O.category(C.CATEGORICAL_FEATURES[2])} as home_ownership, "
    f"{O.category(C.CATEGORICAL_FEATURES[6])} as application_type from ({RAW})",
)
def category_normalisation(spark, sf):
    return raw_loans(spark, sf).select(
        "id", *[P.clean_category(n, C.CATEGORY_ALIASES[n]).alias(n) for n in ("home_ownership", "application_type")]
    )


CANONICAL = ", ".join(
    "cast(cast(issue_month as date) as varchar) as issue_month" if c == "issue_month" else c for c in SPEC.canonical_columns
)


@register("b10_canonical_projection", f"with {O.canonical()} select {CANONICAL} from canonical")
def canonical_projection(spark, sf):
    rows = canonical(spark, sf)
    return rows.select(*[day(c).alias(c) if c == "issue_month" else c for c in rows.columns])


@register("b11_range_filter", f"with {O.canonical()} select loan_id, dti, int_rate from canonical where {O.in_ranges()}")
def range_filter(spark, sf):
    return L.clean_loans(canonical(spark, sf), SPEC).select("loan_id", "dti", "int_rate")


DERIVED = ", ".join(C.DERIVED_FEATURES)


@register("b12_derived_ratios", f"with {O.features()} select loan_id, {DERIVED} from features")
def derived_ratios(spark, sf):
    return rounded(features(spark, sf).select("loan_id", *C.DERIVED_FEATURES))


@register(
    "b13_annuity",
    "select o_orderkey, case when r = 0 then p / n else p * r / (1 - pow(1 + r, -n)) end as payment from "
    "(select o_orderkey, o_totalprice as p, (o_orderkey % 30) / 1200.0e0 as r, "
    "case when o_orderkey % 4 = 0 then 60 else 36 end as n from orders)",
)
def annuity(spark, sf):
    key = F.col("o_orderkey")
    term = F.when(key % 4 == 0, 60).otherwise(36)
    return rounded(V.table(spark, sf, "orders").select("o_orderkey", S.annuity("o_totalprice", key % 30, term).alias("payment")))


@register("b14_risk_band", f"select loan_id, {O.band('p_a')} as band from ({V.oracle(V.SCORED_LOANS)})")
def risk_band(spark, sf):
    return V.view(spark, sf, V.SCORED_LOANS).select("loan_id", S.risk_band("p_a").alias("band"))


LABELS = SPEC.labels
LABEL_SQL = "case " + " ".join(f"when name = '{k}' then '{v}'" for k, v in LABELS.items()) + " else name end"
NAMES_SQL = (
    "select l_orderkey, l_linenumber, case l_partkey % 4 when 0 then 'dti' when 1 then 'log_annual_inc' "
    "when 2 then 'grade' else 'p' || l_suppkey end as name from lineitem"
)


def feature_names(spark, sf):
    part = F.col("l_partkey") % 4
    name = (
        F.when(part == 0, "dti").when(part == 1, "log_annual_inc").when(part == 2, "grade")
        .otherwise(F.concat(F.lit("p"), F.col("l_suppkey").cast("string")))
    )
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", name.alias("name"))


@register("b15_variable_label", f"select name, {LABEL_SQL} as label, count(*) as n from ({NAMES_SQL}) group by all")
def variable_label(spark, sf):
    return feature_names(spark, sf).groupBy("name", PP.feature_label("name", LABELS).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


@register(
    "b16_source_feature",
    "select p_partkey, p_brand || '=' || p_size as dummy, p_brand as source, p_brand as plain from part",
)
def source_feature(spark, sf):
    dummy = F.concat("p_brand", F.lit("="), F.col("p_size").cast("string"))
    return V.table(spark, sf, "part").select(
        "p_partkey", dummy.alias("dummy"), PP.source_feature(dummy).alias("source"), PP.source_feature("p_brand").alias("plain")
    )


@register(
    "b17_next_months",
    "select k as o_custkey, cast(cast(m as date) as varchar) as month from (select o_custkey as k, "
    "unnest(list_filter(list_transform(range(1, 4), lambda i: date_trunc('month', max(o_orderdate)) + to_months(cast(i as int))), "
    "lambda x: x <= timestamp '2001-06-01')) as m from orders group by o_custkey)",
)
def next_months(spark, sf):
    last = V.table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").cast("timestamp").alias("last"))
    stamp = lambda d: F.to_timestamp(F.lit(d))
    months = cal.months_to_process(F.col("last"), stamp("1995-01-01"), 3, stamp("2001-06-15"))
    return last.select("o_custkey", F.explode(months).alias("m")).select("o_custkey", day("m").alias("month"))


@register(
    "b18_non_finite_to_null",
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_discount = 0 then null else l_quantity / l_discount end as v from lineitem",
)
def non_finite(spark, sf):
    value = F.when(F.col("l_discount") != 0, F.col("l_quantity") / F.col("l_discount"))
    broken = F.when(F.col("l_partkey") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return rounded(
        V.table(spark, sf, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", P.null_if_not_finite(F.coalesce(value, broken)).alias("v")
        )
    )


@register(
    "b19_quarter_phase",
    "select o_orderkey, cast(year(o_orderdate) as varchar) || 'Q' || cast(quarter(o_orderdate) as varchar) as quarter, "
    "case when date_trunc('quarter', o_orderdate) between timestamp '1999-01-01' and timestamp '1999-04-01' then 'validación' "
    "when date_trunc('quarter', o_orderdate) between timestamp '1999-07-01' and timestamp '1999-10-01' then 'test' "
    "else 'producción' end as phase from orders",
)
def quarter_phase(spark, sf):
    phase = cal.quarter_phase("o_orderdate", ("1999-01-01", "1999-06-01"), ("1999-07-01", "1999-12-01"))
    return V.table(spark, sf, "orders").select("o_orderkey", cal.quarter_label("o_orderdate").alias("quarter"), phase.alias("phase"))


FACTOR, OFFSET = S.point_factor(), S.point_offset()


@register(
    "b20_points",
    digits=9,
    sql=f"select loan_id, {OFFSET!r} + {FACTOR!r} * ln((1 - p_a) / p_a) as points, p_a as back from ({V.oracle(V.SCORED_LOANS)})",
)
def points(spark, sf):
    rows = V.view(spark, sf, V.SCORED_LOANS).select("loan_id", S.pd_to_points("p_a").alias("points"))
    return rounded(rows.withColumn("back", S.points_to_pd("points")), 9)


@register(
    "b21_row_log_loss",
    "select loan_id, -(y * ln(p) + (1 - y) * ln(1 - p)) as loss, cast((p >= 0.3) <> (y = 1) as int) as error from "
    f"(select loan_id, y, least(greatest(p_a, 1e-7), 1 - 1e-7) as p from ({V.oracle(V.SCORED_LOANS)}) where y is not null)",
)
def row_log_loss(spark, sf):
    rows = V.view(spark, sf, V.SCORED_LOANS).filter("y is not null")
    p = S.clip("p_a", 1e-7, 1 - 1e-7)
    return rounded(rows.select("loan_id", S.log_loss("y", p).alias("loss"), S.misclassified("y", p, 0.3).alias("error")))


@register(
    "b22_record_fingerprint",
    "select c_custkey, sha256('{\"c_custkey\":' || c_custkey || ',\"c_mktsegment\":\"' || c_mktsegment || "
    "'\",\"c_name\":\"' || c_name || '\",\"missing\":null}') as input_hash from customer",
)
def record_fingerprint(spark, sf):
    rows = V.table(spark, sf, "customer").withColumn("missing", F.lit(None).cast("double"))
    names = ["missing", "c_name", "c_custkey", "c_mktsegment"]
    return rows.select("c_custkey", dec_.fingerprint(names).alias("input_hash"))


@register(
    "b23_numeric_coercion",
    f"select id, try_cast(fico_range_low as double) as a, try_cast(int_rate as double) as b, try_cast(issue_d as double) as c from ({RAW})",
)
def numeric_coercion(spark, sf):
    return raw_loans(spark, sf).select(
        "id", P.as_number("fico_range_low").alias("a"), P.as_number("int_rate").alias("b"), P.as_number("issue_d").alias("c")
    )


@register(
    "b24_parse_reasons",
    "select o_orderkey, case o_orderkey % 4 when 0 then 'A|' || o_orderpriority when 1 then o_orderpriority else '' end as reasons, "
    "case o_orderkey % 4 when 0 then 2 when 1 then 1 else 0 end as n from orders",
)
def parse_reasons(spark, sf):
    kind = F.col("o_orderkey") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit('["A","'), F.col("o_orderpriority"), F.lit('"]')))
        .when(kind == 1, F.col("o_orderpriority"))
        .when(kind == 2, F.lit(""))
    )
    parsed = dec_.parse_reasons(text)
    return V.table(spark, sf, "orders").select("o_orderkey", F.array_join(parsed, "|").alias("reasons"), F.size(parsed).alias("n"))


def _error_sql() -> str:
    checks = []
    for name, (low, high, required) in dec_.APPLICATION_RANGES.items():
        ok = f"{name} between {low} and {high}"
        checks.append((name, ok if required else f"({ok} or {name} is null)"))
    checks.append(("annual_inc", "annual_inc > 0 and annual_inc <= 10000000"))
    checks.append(("term_months", "term_months in (36, 60)"))
    checks += [(n, f"{n} in {O.text_list(v)}") for n, v in dec_.APPLICATION_LISTS.items()]
    checks.append(("sub_grade", f"regexp_matches(sub_grade, '{C.SUB_GRADE_PATTERN}')"))
    checks.append(("sub_grade_vs_grade", "starts_with(sub_grade, grade)"))
    checks.append(("loan_id", f"(loan_id is null or regexp_matches(loan_id, '{C.ID_PATTERN}'))"))
    return "[" + ", ".join(f"case when not coalesce({ok}, false) then '{code}' end" for code, ok in checks) + "]"


@register(
    "b25_record_validation",
    f"with {O.canonical()}, e as (select loan_id, list_filter({_error_sql()}, lambda x: x is not null) as errors from canonical) "
    "select loan_id, array_to_string(errors, '|') as errors, len(errors) = 0 as valid from e",
)
def record_validation(spark, sf):
    errors = dec_.application_errors()
    return canonical(spark, sf).select(
        "loan_id", F.array_join(errors, "|").alias("errors"), (F.size(errors) == 0).alias("valid")
    )


# --- D1-D8, W7: quality --------------------------------------------------------------------------
@register(
    "d01_loans_per_year",
    f"with {O.canonical()} select cast(year(issue_month) as int) as year, count(*) as loans, avg(target_default) as default_rate from canonical group by 1",
)
def loans_per_year(spark, sf):
    return rounded(Q.loans_per_year(canonical(spark, sf), "issue_month", "target_default"))


def _suite_sql(source: str, min_rows: int) -> str:
    rows = [
        ("row_count_min", "*", f"count(*) >= {min_rows}", "count(*)", min_rows, "error"),
        ("unique_id", "loan_id", None, "1 - count(distinct coalesce(loan_id, '')) * 1.0 / count(*)", 0, "error"),
        ("valid_issue_date", "issue_month", None, "avg(cast(issue_month is null as int))", 0, "error"),
    ]
    for f in C.NUMERIC_FEATURES:
        rows.append(("null_rate", f.name, None, f"avg(cast({f.name} is null as int))", f.null_limit, "error"))
        low = f"coalesce(cast({f.name} < {f.low} as int), 0)" if f.low is not None else "0"
        high = f"coalesce(cast({f.name} > {f.high} as int), 0)" if f.high is not None else "0"
        rows.append(("min_value", f.name, None, f"avg({low})", 0.001, "warning"))
        rows.append(("max_value", f.name, None, f"avg({high})", 0.001, "warning"))
    for f in C.CATEGORICAL_FEATURES:
        rows.append(("null_rate", f.name, None, f"avg(cast({f.name} is null as int))", 0.01, "error"))
        if f.values:
            unknown = f"coalesce(cast({f.name} not in {O.text_list(f.values)} as int), 0)"
            rows.append(("known_categories", f.name, None, f"avg({unknown})", 0.001, "warning"))
    rows.append(("default_rate_range", "target_default", "avg(target_default) between 0.03 and 0.40", "avg(target_default)", 0.40, "error"))
    rows.append(("no_leakage_columns", "-", "count(*) >= 0", "0 * count(*)", 0, "error"))
    parts = []
    for name, column, passed, observed, limit, severity in rows:
        ok = passed or f"({observed}) <= {limit}"
        parts.append(
            f"select '{name}' as name, '{column}' as column_name, coalesce({ok}, false) as passed, cast({observed} as double) as observed, "
            f"cast({limit} as double) as threshold, '{severity}' as severity from {source}"
        )
    return " union all ".join(parts)


@register("d02_expectations", f"with {O.canonical()} {_suite_sql('canonical', 1000)}")
def expectations(spark, sf):
    return rounded(Q.expectations(silver(spark, sf), SPEC))


@register("d04_quality_log", f"with {O.canonical()} select 'bronze->silver' as layer, * from ({_suite_sql('canonical', 1000)})")
def quality_log(spark, sf):
    return rounded(Q.quality_log(Q.expectations(silver(spark, sf), SPEC), "bronze->silver").drop("run_ts"))


@register("d03_quality_gate", "select count(*) as loans from orders where o_orderkey % 97 <> 0 and o_orderkey % 101 <> 0")
def quality_gate(spark, sf):
    """The gate on rows whose ranges, nulls and dates are repaired first; a failing suite raises."""
    rows = silver(spark, sf)
    filled = {
        f.name: F.coalesce(S.clip(f.name, f.low or 0, f.high or 1e12), P.dec(f.low or 0)) for f in SPEC.numeric
    }
    repaired = rows.withColumns(filled).withColumn(
        "issue_month", F.coalesce("issue_month", F.to_timestamp(F.lit("1995-01-01")))
    ).withColumn("target_default", F.when(F.col("loan_amnt") % 3 == 0, 1.0).otherwise(0.0))
    Q.assert_quality(Q.expectations(repaired, SPEC, min_rows=1))
    return repaired.agg(F.count(F.lit(1)).alias("loans"))


@register(
    "d05_duplicate_share",
    "select count(*) as rows, 0::bigint as null_keys, count(*) - count(distinct l_orderkey) as duplicate_rows from lineitem",
)
def duplicate_share(spark, sf):
    return L.primary_key_violations(V.table(spark, sf, "lineitem"), "l_orderkey")


CATS = SPEC.categorical_names


@register(
    "d06_category_shares",
    f"with {O.features()} select * from ("
    + " union all ".join(
        f"select '{c}' as feature, coalesce({c}, '__missing__') as value, count(*) as n, "
        f"count(*) * 1.0 / (select count(*) from features) as share from features group by 2"
        for c in CATS
    )
    + ") where share >= 0.005",
)
def category_shares(spark, sf):
    return rounded(Q.category_shares(features(spark, sf), CATS, C.MISSING, 0.005))


NUMS = SPEC.numeric_names + list(C.DERIVED_FEATURES)


@register(
    "d07_exact_medians",
    f"with {O.features()} "
    + " union all ".join(f"select '{c}' as feature, coalesce(quantile_cont({c}, 0.5), 0) as median from features" for c in NUMS),
)
def exact_medians(spark, sf):
    return rounded(PP.medians(written_features(spark, sf), NUMS))


@register(
    "d08_missing_indicators",
    f"with {O.features()} select * from ("
    + " union all ".join(
        f"select '{c}' as feature, avg(cast({c} is null as int)) as null_share from features" for c in SPEC.numeric_names
    )
    + ") where null_share >= 0.001",
)
def missing_indicators(spark, sf):
    return rounded(PP.null_shares(features(spark, sf), SPEC.numeric_names).filter("null_share >= 0.001"))


@register(
    "w07_one_row_per_id",
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from (select *, row_number() over (partition by l_orderkey "
    "order by l_linenumber, l_partkey, l_suppkey, l_quantity) as rn from lineitem) where rn = 1",
)
def one_row_per_id(spark, sf):
    lines = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return L.keep_first(lines, "l_orderkey", ["l_linenumber"])


# --- M1-M4, O5, O6, D51, U4: features and splits -------------------------------------------------
FIT_SQL = (
    f"with {O.features()} select 'median' as kind, feature, cast(null as varchar) as value, median as number from ("
    + " union all ".join(f"select '{c}' as feature, coalesce(quantile_cont({c}, 0.5), 0) as median from features" for c in NUMS)
    + ") union all select 'indicator', feature, null, null from ("
    + " union all ".join(f"select '{c}' as feature, avg(cast({c} is null as int)) as s from features" for c in SPEC.numeric_names)
    + ") where s >= 0.001 union all select 'level', feature, value, null from ("
    + " union all ".join(
        f"select '{c}' as feature, coalesce({c}, '__missing__') as value, count(*) * 1.0 / (select count(*) from features) as share "
        f"from features group by 2"
        for c in CATS
    )
    + ") where share >= 0.005"
)


@register("m01_preprocessor_fit", FIT_SQL)
def preprocessor_fit(spark, sf):
    fitted = PP.Preprocessor(SPEC).fit(written_features(spark, sf))
    rows = [("median", n, None, v) for n, v in fitted.medians.items()]
    rows += [("indicator", n, None, None) for n in fitted.indicators]
    rows += [("level", n, v, None) for n, values in fitted.vocabulary.items() for v in values]
    return rounded(spark.createDataFrame(rows, "kind string, feature string, value string, number double"))


def _transform_sql() -> str:
    nulls = " + ".join(f"cast({c} is null as int)" for c in SPEC.numeric_names)
    return (
        f"with {O.features()}, med as (select " + ", ".join(f"coalesce(quantile_cont({c}, 0.5), 0) as m_{c}" for c in NUMS)
        + " from features), g as (select coalesce(purpose, '__missing__') as v from features group by 1 "
        "having count(*) >= 0.005 * (select count(*) from features)) select loan_id, "
        + " + ".join(f"coalesce({c}, m_{c})" for c in NUMS)
        + f" as numeric_sum, cast({nulls} as double) as flags, cast(purpose = 'building' as double) as purpose_building, "
        "cast(coalesce(purpose, '__missing__') not in (select v from g) as double) as purpose_other from features, med"
    )


@register("m02_preprocessor_transform", _transform_sql())
def preprocessor_transform(spark, sf):
    rows = written_features(spark, sf)
    fitted = PP.Preprocessor(SPEC, min_missing_share=0.0).fit(rows)
    matrix = fitted.transform(rows, ["loan_id"])
    total = sum((F.col(n) for n in NUMS), F.lit(0.0))
    flags = sum((F.col(f"{n}={C.MISSING}") for n in SPEC.numeric_names), F.lit(0.0))
    return rounded(
        matrix.select(
            "loan_id",
            total.alias("numeric_sum"),
            flags.alias("flags"),
            F.col("purpose=building").alias("purpose_building"),
            F.col(f"purpose={C.OTHER}").alias("purpose_other"),
        )
    )


CUTS = ("1997-01-01", "1999-01-01", "2001-01-01")
SPLIT_SQL = (
    f"case when issue_month < timestamp '{CUTS[0]}' then 'train' when issue_month < timestamp '{CUTS[1]}' then 'validation' "
    f"when issue_month < timestamp '{CUTS[2]}' then 'test' end"
)


@register(
    "m03_out_of_time_split",
    f"with {O.features()}, s as (select loan_id, {SPLIT_SQL} as split, target_default from features where target_default is not null) "
    "select * from s where split is not null",
)
def out_of_time_split(spark, sf):
    return PP.out_of_time_splits(features(spark, sf), SPEC, *CUTS).select("loan_id", "split", "target_default")


@register(
    "d51_split_summary",
    f"with {O.features()}, s as (select issue_month, {SPLIT_SQL} as split, target_default from features where target_default is not null) "
    "select split, cast(cast(min(issue_month) as date) as varchar) as first_month, cast(cast(max(issue_month) as date) as varchar) as last_month, "
    "count(*) as n, avg(target_default) as default_rate from s where split is not null group by split",
)
def split_summary(spark, sf):
    from underwrite.operators.analysis import split_summary as summarise

    splits = PP.out_of_time_splits(features(spark, sf), SPEC, *CUTS)
    table = summarise(splits, "split", "issue_month", "target_default")
    return rounded(table.withColumns({"first_month": day("first_month"), "last_month": day("last_month")}))


@register(
    "m04_moving_windows",
    "select m as as_of, cast(cast(m - interval 5 month - interval 12 month as date) as varchar) as train_end, "
    "cast(cast(m - interval 5 month - interval 6 month as date) as varchar) as validation_end, "
    "cast(cast(m - interval 5 month as date) as varchar) as test_end, n from (select date_trunc('month', o_orderdate) as m, count(*) as n "
    "from orders group by 1)".replace("select m as as_of", "select cast(cast(m as date) as varchar) as as_of"),
)
def moving_windows(spark, sf):
    months = V.table(spark, sf, "orders").groupBy(cal.month_start("o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    cuts = cal.moving_split_dates("m", 6)
    return months.select(
        day("m").alias("as_of"),
        *[cuts[c].cast("date").cast("string").alias(c) for c in ("train_end", "validation_end", "test_end")],
        "n",
    )


@register(
    "o05_bounded_sample",
    "select o_orderkey, m as month from (select o_orderkey, cast(cast(date_trunc('month', o_orderdate) as date) as varchar) as m, row_number() over "
    "(partition by date_trunc('month', o_orderdate) order by cast('0x' || substr(md5('42:' || o_orderkey), 1, 15) as bigint)) as rn from orders) where rn <= 100",
)
def bounded_sample(spark, sf):
    rows = V.table(spark, sf, "orders").select("o_orderkey", cal.month_start("o_orderdate").cast("date").cast("string").alias("month"))
    return PP.bounded_sample(rows, ["month"], "o_orderkey", 100)


@register("o06_fractional_sample", f"select o_orderkey from orders where {O.bucket('o_orderkey', 'sample')} < 0.3")
def fractional_sample(spark, sf):
    return PP.fractional_sample(V.table(spark, sf, "orders"), "o_orderkey", 0.3).select("o_orderkey")


@register(
    "u04_column_difference",
    "select o_orderkey, case o_orderkey % 3 when 0 then 'b' when 1 then 'a|b' else '' end as missing from orders",
)
def column_difference(spark, sf):
    kind = F.col("o_orderkey") % 3
    tags = F.map_filter(
        F.create_map(F.lit("a"), F.when(kind != 1, F.lit("x")), F.lit("b"), F.when(kind == 2, F.lit("y"))),
        lambda _, v: v.isNotNull(),
    )
    required = F.array(F.lit("a"), F.lit("b"))
    return V.table(spark, sf, "orders").select(
        "o_orderkey", F.array_join(F.array_except(required, F.map_keys(tags)), "|").alias("missing")
    )


@register("x01_parse_as_expressions", f"with {O.features()} select count(*) as loans, count(target_default) as labelled, avg(loan_to_income) as loan_to_income from features")
def parse_as_expressions(spark, sf):
    """The three row-wise batch steps (parse, clean, derive) fused into one native projection."""
    return rounded(
        features(spark, sf).agg(
            F.count(F.lit(1)).alias("loans"), F.count("target_default").alias("labelled"), F.avg("loan_to_income").alias("loan_to_income")
        )
    )
