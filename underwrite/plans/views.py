"""Loan-domain views of the given tables.

One SQL text serves Spark and the oracle engine. Table names stand in braces: Spark binds them to
DataFrames, the oracle sees the plain names. Integer remainders spread values over every rule the
operators have (blanks, footers, unknown texts, out-of-range numbers).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from underwrite.session import prepare

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
)

MONTH_TEXT = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(3 * (month(o_orderdate) - 1) + 1 as int), 3)"

RAW_LOANS = f"""
select
  case when o_orderkey % 11 = 0 then ' ' || cast(o_orderkey as string) || ' ' else cast(o_orderkey as string) end as id,
  case when o_orderkey % 97 = 0 then 'Total amount funded' when o_orderkey % 101 = 0 then null
       else cast(400 + (o_orderkey * 37) % 39800 as string) end as loan_amnt,
  case when o_orderkey % 4 = 0 then ' 60 months' else ' 36 months' end as term,
  cast(4 + o_orderkey % 28 as string) || '.' || cast(10 + (o_orderkey * 7) % 90 as string) || '%' as int_rate,
  cast(20 + (o_orderkey * 13) % 1500 as string) || '.5' as installment,
  substr('ABCDEFG', cast(1 + o_orderkey % 7 as int), 1) as grade,
  substr('ABCDEFG', cast(1 + (o_orderkey + case when o_orderkey % 53 = 0 then 1 else 0 end) % 7 as int), 1)
    || cast(1 + o_orderkey % 5 as string) as sub_grade,
  case o_orderkey % 13 when 0 then null when 1 then '1 year' when 10 then '10+ years' when 11 then '< 1 year'
       when 12 then 'n/a' else cast(o_orderkey % 13 as string) || ' years' end as emp_length,
  case o_orderkey % 6 when 0 then 'MORTGAGE' when 1 then 'RENT' when 2 then 'OWN' when 3 then 'ANY' when 4 then 'NONE'
       else ' RENT ' end as home_ownership,
  case when c_acctbal > 0 then cast(cast(floor(c_acctbal * 12) as bigint) as string) when c_acctbal < -500 then null
       else '0' end as annual_inc,
  case o_orderkey % 3 when 0 then 'Not Verified' when 1 then 'Source Verified' else 'Verified' end as verification_status,
  case when o_orderkey % 89 = 0 then 'Sep-20x1'
       else {MONTH_TEXT} || '-' || cast(year(o_orderdate) as string) || case when o_orderkey % 5 = 0 then ' ' else '' end
       end as issue_d,
  case when o_orderstatus = 'P' then case when o_orderkey % 2 = 0 then 'Charged Off' else 'Default' end
       when o_orderstatus = 'F' then case when o_orderkey % 9 = 0
            then 'Does not meet the credit policy. Status:Fully Paid' else 'Fully Paid ' end
       else 'Current' end as loan_status,
  lower(c_mktsegment) as purpose,
  'N' || cast(n_nationkey as string) as addr_state,
  case when o_orderkey % 43 = 0 then null else cast((o_orderkey * 3) % 110 as string) || '.25' end as dti,
  cast(o_orderkey % 4 as string) as delinq_2yrs,
  {MONTH_TEXT} || '-' || cast(1960 + o_orderkey % 34 as string) as earliest_cr_line,
  cast(600 + 5 * (o_orderkey % 51) as string) as fico_range_low,
  case when o_orderkey % 31 = 0 then null else cast(604 + 5 * (o_orderkey % 51) as string) end as fico_range_high,
  cast(o_orderkey % 5 as string) as inq_last_6mths,
  cast(1 + o_orderkey % 30 as string) as open_acc,
  cast(o_orderkey % 3 as string) as pub_rec,
  cast((o_orderkey * 91) % 60000 as string) as revol_bal,
  case when o_orderkey % 61 = 0 then '' else cast((o_orderkey * 17) % 120 as string) || '.5%' end as revol_util,
  cast(o_orderkey % 37 as string) as total_acc,
  case when o_orderkey % 19 = 0 then null else cast(o_orderkey % 6 as string) end as mort_acc,
  cast(o_orderkey % 2 as string) as pub_rec_bankruptcies,
  case when o_orderkey % 2 = 0 then 'w' else 'f' end as initial_list_status,
  case o_orderkey % 4 when 0 then 'INDIVIDUAL' when 1 then 'JOINT' when 2 then 'Joint App' else 'Individual' end
    as application_type,
  cast(o_orderkey as string) as total_pymnt
from {{orders}} join {{customer}} on o_custkey = c_custkey join {{nation}} on c_nationkey = n_nationkey
"""

# A three-state label and two scores with many ties.
SCORED_LINES = """
select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate,
  cast(year(l_shipdate) as string) || 'Q' || cast(quarter(l_shipdate) as string) as quarter,
  case l_returnflag when 'R' then 1 when 'A' then 0 end as y,
  least(0.98, 0.05 + 3 * l_discount + 0.004 * l_quantity + case when l_returnflag = 'R' then 0.08 else 0 end) as p_a,
  least(0.98, 0.05 + 2 * l_tax + 0.004 * l_quantity + case when l_returnflag = 'R' then 0.03 else 0 end) as p_b,
  l_discount as p_c
from {lineitem}
"""

# Near-unique scores with a unique numeric id.
SCORED_LOANS = """
select o_orderkey as loan_id, o_custkey, date_trunc('month', o_orderdate) as issue_month, o_orderdate,
  case o_orderstatus when 'P' then 1 when 'F' then 0 end as y,
  least(0.95, 0.02 + o_totalprice / cast(700000 as double)
    + case when o_orderstatus = 'P' then cast(0.06 as double) else cast(0 as double) end) as p_a,
  least(0.95, 0.02 + ((o_totalprice * 7) % 400000) / cast(600000 as double)
    + case when o_orderstatus = 'P' then cast(0.08 as double) else cast(0 as double) end) as p_b,
  0.05 + (o_orderkey % 90) / cast(100 as double) as p_c
from {orders}
"""

INFERENCE_LOG = """
select event_id as request_id, cast(user_id as string) as loan_id, ts as event_ts,
  case when event_type in ('view', 'click', 'error') then 'replay' else 'api' end as source,
  case when user_id % 5 = 0 and ts >= timestamp '2024-01-08 00:00:00' then 'challenger' else 'champion' end as variant,
  case when user_id % 5 = 0 and ts >= timestamp '2024-01-08 00:00:00' then '2' else '1' end as model_version,
  case when event_id % 50 = 7 then null
       else least(0.98, value / 500 + case when event_type = 'error' then 0.05 else 0 end) end as probability,
  case when value < 60 then 'APROBAR' when value < 80 then 'REVISION_MANUAL' else 'RECHAZAR' end as decision,
  event_type, value
from {events}
"""

OUTCOMES = """
select event_id as request_id, cast(user_id as string) as loan_id,
  case when event_type = 'error' then 1 else 0 end as actual_default,
  ts + interval 6 day as observed_ts
from {events} where event_type <> 'signup'
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Bind the tables a view text names and return it as a DataFrame."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def oracle(text: str) -> str:
    """The same view for an engine that knows the tables by name."""
    return text.format(**{t: t for t in TABLES})
