"""The query catalogue: each operator on the driver's tables, with the SQL that DuckDB runs for comparison.

The audit tables (runs, findings, verdicts, calls) do not exist in the data; they are derived from the star
schema by the same rule in both engines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .functions import geo, registered
from .operators import analytics, chains, checks, graph, monitor, planning, producers, quality, relops, rules
from .plans import compiler, digest
from .session import shared_folder
from .sources.tables import percentage_sample, schema_rows, stringify_batch, tables
from .streaming import late, merge

Build = Callable[[Callable[[str], DataFrame]], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, build: Build, sql: str | None = None) -> None:
    """``build`` gets a function from table names to DataFrames (and carries the session as ``.spark``)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def table(name: str) -> DataFrame:
            return tables(spark, sf_dir, name)[name]

        table.spark = spark
        return build(table)

    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


def text_query(name: str, text: str, *names: str, duck: str | None = None, exact: bool = False) -> None:
    """A query of the dialect, run through our parser and compiler; DuckDB runs the same text."""
    register(name, lambda t: compiler.run(t.spark, text, {n: t(n) for n in names}, exact), duck or text)


r = lambda column, digits=4: F.round(column, digits)

# ---------------------------------------------------------------- the flagship and the counting layer


def _lifetime(t):
    per = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("most_recent_order"), F.count("*").alias("number_of_orders"), r(F.sum("o_totalprice"), 2).alias("lifetime_value"))
    return t("customer").select("c_custkey", "c_name").join(per, "c_custkey", "left")


register("entry_customer_lifetime", _lifetime, """
select c_custkey, c_name, first_order, most_recent_order, number_of_orders, lifetime_value from customer left join (
  select o_custkey, min(o_orderdate) first_order, max(o_orderdate) most_recent_order, count(*) number_of_orders, round(sum(o_totalprice), 2) lifetime_value from orders group by 1) on c_custkey = o_custkey""")


def _scan_sql(relation: str, columns: list[str]) -> str:
    parts = [f"select '{relation}' relation, '{c}' column_name, count(*) row_count, count({c}) non_null, count(distinct {c}) distinct_ct from {relation}" for c in columns]
    return f"select *, case when non_null < row_count then 'has_nulls' when distinct_ct < non_null then 'has_duplicates' else 'unique' end status from ({' union all '.join(parts)})"


_SCANS = {"orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"], "lineitem": ["l_orderkey", "l_partkey", "l_linenumber"], "customer": ["c_custkey", "c_name"], "nation": ["n_nationkey", "n_regionkey"]}
for _name in ("orders", "lineitem"):
    register(f"key_scan_{_name}", lambda t, n=_name: quality.key_scan(t(n), n, _SCANS[n]), _scan_sql(_name, _SCANS[_name]))
register("key_scan_batch", lambda t: quality.key_scan_batch({n: (t(n), c) for n, c in _SCANS.items()}), " union all ".join(f"({_scan_sql(n, c)})" for n, c in _SCANS.items()))
register("is_unique_key", lambda t: quality.settled_unique(quality.key_scan(t("orders"), "orders", ["o_orderkey", "o_custkey"])).select("column_name", "is_key"), "select 'o_orderkey' column_name, count(*) = count(distinct o_orderkey) is_key from orders union all select 'o_custkey', count(*) = count(distinct o_custkey) from orders")
_PROFILE = " union all ".join(f"select '{c}' column_name, min(try_cast({c} as double)) lo, max(try_cast({c} as double)) hi, count(try_cast({c} as double)) n from {t}" for t, c in (("lineitem", "l_quantity"), ("lineitem", "l_returnflag"), ("lineitem", "l_discount")))
register("profile_numeric", lambda t: quality.profile(t("lineitem"), ["l_quantity", "l_returnflag", "l_discount"]).withColumn("lo", F.col("lo") + 0.0).withColumn("hi", F.col("hi") + 0.0), f"select column_name, lo + 0.0 lo, hi + 0.0 hi, n from ({_PROFILE})")
register("sentinel_extremes", lambda t: quality.sentinel_extremes(quality.profile(t("customer").select((F.when(F.col("c_custkey") % 10 == 0, -1.0).otherwise(F.abs("c_acctbal"))).alias("balance"), (F.lit(9999) - F.col("c_nationkey")).alias("code"), "c_custkey"), ["balance", "code", "c_custkey"])), """
with p as (select case when c_custkey % 10 = 0 then -1.0 else abs(c_acctbal) end::double balance, (9999 - c_nationkey)::double code, c_custkey::double c_custkey from customer),
e as (select 'balance' column_name, min(balance) lo, max(balance) hi from p union all select 'code', min(code), max(code) from p union all select 'c_custkey', min(c_custkey), max(c_custkey) from p)
select column_name, 'min' extreme, lo as value from e where lo in (-9999, -999, -1, 9999, 99999, -99999) union all select column_name, 'max', hi from e where hi in (-9999, -999, -1, 9999, 99999, -99999)""")
register("unit_range_conflicts", lambda t: quality.unit_conflicts(quality.profile(t("customer"), ["c_acctbal"]).union(quality.profile(t("part"), ["p_size", "p_retailprice"])), t.spark.createDataFrame([("c_acctbal", "kilograms", 1e6, False), ("p_size", "percent", 40.0, False), ("p_retailprice", "currency", 1e9, True)], "column_name string, unit string, bound double, may_be_negative boolean")), """
with e as (select 'c_acctbal' column_name, min(c_acctbal) lo, max(c_acctbal) hi from customer union all select 'p_size', min(p_size), max(p_size) from part union all select 'p_retailprice', min(p_retailprice), max(p_retailprice) from part),
b as (select * from (values ('c_acctbal', 'kilograms', 1e6, false), ('p_size', 'percent', 40.0, false), ('p_retailprice', 'currency', 1e9, true)) v(column_name, unit, bound, neg))
select * from (select column_name, unit, lo::double lo, hi::double hi, case when hi > bound then 'above_bound' when lo < 0 and not neg then 'negative' end conflict from e join b using (column_name)) where conflict is not null""")
register("minimality_lineitem", lambda t: quality.minimality(t("lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"]), " union all ".join(f"select '{c}' column_name, count(distinct (l_orderkey, l_linenumber, l_partkey)) \"full\", count(distinct ({w})) \"without\", case when count(distinct (l_orderkey, l_linenumber, l_partkey)) = count(distinct ({w})) then 'carried' else 'adds' end minimality from lineitem" for c, w in (("l_orderkey", "l_linenumber, l_partkey"), ("l_linenumber", "l_orderkey, l_partkey"), ("l_partkey", "l_orderkey, l_linenumber"))))
register("join_key_unique", lambda t: quality.join_key_unique(t("nation"), "nation", ["n_nationkey"]).union(quality.join_key_unique(t("lineitem"), "lineitem", ["l_orderkey", "l_linenumber"])), "select 'nation' relation, count(*) n, count(distinct n_nationkey) d, not (count(*) > 0 and count(distinct n_nationkey) >= count(*)) fans_out from nation union all select 'lineitem', count(*), count(distinct (l_orderkey, l_linenumber)), not (count(*) > 0 and count(distinct (l_orderkey, l_linenumber)) >= count(*)) from lineitem")
register("grain_verdict", lambda t: quality.grain_verdict(t("orders"), "orders", ["o_orderkey"]).union(quality.grain_verdict(t("orders"), "orders_by_customer", ["o_custkey", "o_orderdate"])).union(quality.grain_verdict(t("orders").where("o_orderkey < 0"), "none", ["o_orderkey"])), "select 'orders' relation, count(*) n, count(distinct o_orderkey) d, case when count(*) = 0 then 'empty' when count(distinct o_orderkey) < count(*) then 'fails' else 'holds' end verdict from orders union all select 'orders_by_customer', count(*), count(distinct (o_custkey, o_orderdate)), case when count(*) = 0 then 'empty' when count(distinct (o_custkey, o_orderdate)) < count(*) then 'fails' else 'holds' end from orders union all select 'none', 0, 0, 'empty'")
register("fanout_ratio", lambda t: quality.join_size(t("orders"), t("lineitem"), [("o_orderkey", "l_orderkey")]).withColumn("ratio", r(F.col("ratio"), 6)), "select (select count(*) from orders) n_left, count(*) n_joined, round(count(*) / (select count(*) from orders), 6) ratio from orders join lineitem on o_orderkey = l_orderkey")
register("fanout_left", lambda t: quality.join_size(t("orders"), t("lineitem").where("l_quantity > 45"), [("o_orderkey", "l_orderkey")], "left").withColumn("ratio", r(F.col("ratio"), 6)), "select (select count(*) from orders) n_left, count(*) n_joined, round(count(*) / (select count(*) from orders), 6) ratio from orders left join (select * from lineitem where l_quantity > 45) on o_orderkey = l_orderkey")
register("row_loss_hop", lambda t: quality.row_loss(t("orders"), t("orders").where("o_totalprice > 450000"), "orders>large").withColumn("kept", r(F.col("kept"), 6)), "select 'orders>large' hop, count(*) n_parent, count(*) filter (where o_totalprice > 450000) n_child, round(count(*) filter (where o_totalprice > 450000) / count(*), 6) kept, count(*) filter (where o_totalprice > 450000) / count(*) < 0.2 drops_most from orders")
register("value_loss_cast", lambda t: quality.value_loss(t("events"), "props>k", "props", F.get_json_object("props", "$.k").try_cast("int") + F.when(F.col("event_id") % 7 == 0, None).otherwise(0)).withColumn("share", r(F.col("share"), 6)), "select 'props>k' hop, count(*) present, count(*) filter (where x is null) lost, round(count(*) filter (where x is null) / count(*), 6) share, case when count(*) filter (where x is null) / count(*) >= 0.05 or count(*) filter (where x is null) >= 1000 then 3 else 2 end base from (select case when event_id % 7 = 0 then null else try_cast(json_extract_string(props, '$.k') as int) end x from events where props is not null and upper(trim(props)) not in ('', 'NA', 'N/A', 'NULL', 'NONE', 'NAN'))")
register("default_share", lambda t: quality.default_share(t("events"), F.coalesce(F.when(F.col("event_id") % 5 == 0, None).otherwise(F.floor("value")), F.lit(0)), 0).withColumn("share", r(F.col("share"), 6)), "select count(*) n, count(*) filter (where x = 0) n_default, round(count(*) filter (where x = 0) / count(*), 6) share from (select coalesce(case when event_id % 5 = 0 then null else floor(value) end, 0) x from events)")
register("lateness_seconds", lambda t: quality.lateness(t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")), "o_orderdate", "l_shipdate"), "select max(epoch(l_shipdate)::bigint - epoch(o_orderdate)::bigint) max_late_seconds, count(*) rows_read from lineitem join orders on l_orderkey = o_orderkey")
register("unique_per_batch", lambda t: quality.unique_per_batch(t("lineitem").withColumn("batch_year", F.year("l_shipdate")), "batch_year", ["l_orderkey"]), "select y batch, count(*) n_keys, count(*) filter (where n > 1) n_repeated from (select year(l_shipdate)::int y, l_orderkey, count(*) n from lineitem group by 1, 2) group by 1")


def _observed(t):
    """One observation a year for each order priority, with a status that follows the counts."""
    per = t("orders").groupBy(F.col("o_orderpriority").alias("column_name"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    status = F.when(F.col("n") % 3 == 0, "unique").when(F.col("n") % 3 == 1, "has_nulls").otherwise("has_duplicates")
    return per.select(F.lit("orders").alias("relation"), "column_name", F.make_date("y", F.lit(1), F.lit(1)).alias("observed_at"), status.alias("status"), F.when(F.col("n") % 2 == 0, "carried").otherwise("adds").alias("minimality"), F.lit(False).alias("sampled"), "n")


_OBSERVED_SQL = """observed as (select 'orders' relation, o_orderpriority column_name, make_date(year(o_orderdate), 1, 1) observed_at, case when count(*) % 3 = 0 then 'unique' when count(*) % 3 = 1 then 'has_nulls' else 'has_duplicates' end status, case when count(*) % 2 = 0 then 'carried' else 'adds' end minimality, count(*) n from orders group by o_orderpriority, year(o_orderdate))"""
register("key_drift", lambda t: quality.key_drift(_observed(t)), f"""with {_OBSERVED_SQL}, p as (select relation, column_name, status now, minimality mnow, lead(status) over w was, lead(minimality) over w mwas, row_number() over w k from observed window w as (partition by relation, column_name order by observed_at desc))
select * from (select relation, column_name, case when was = 'unique' and now <> 'unique' then 'key_stopped_holding' when was <> 'unique' and now = 'unique' then 'key_started_holding' when mwas = 'carried' and mnow = 'adds' then 'key_column_started_mattering' when mwas = 'adds' and mnow = 'carried' then 'key_column_stopped_mattering' end change from p where k = 1) where change is not null""")
register("latest_observation", lambda t: relops.pick(_observed(t), ["relation", "column_name"], ["observed_at desc"]).select("column_name", "observed_at", "n"), f"with {_OBSERVED_SQL} select column_name, observed_at, n from observed qualify row_number() over (partition by relation, column_name order by observed_at desc) = 1")
register("probe_order", lambda t: quality.probe_order(t("nation").select(F.col("n_name").alias("relation"), F.col("n_regionkey").alias("reach")), t("nation").where("n_nationkey % 3 > 0").select(F.col("n_name").alias("relation"), F.make_date(F.lit(2020), F.col("n_nationkey") % 12 + 1, F.lit(1)).alias("observed_at"))), "select n_name relation, n_regionkey reach, case when n_nationkey % 3 > 0 then make_date(2020, n_nationkey % 12 + 1, 1) end last_at from nation")
register("relationship_orphans", lambda t: quality.orphans(t("lineitem"), t("part").where("p_size <= 40"), "l_partkey", "p_partkey"), "select count(*) n_checked, count(*) filter (where p_partkey is null) n_orphans from lineitem left join (select p_partkey from part where p_size <= 40) on l_partkey = p_partkey")
register("accepted_values", lambda t: quality.accepted_values(t("orders"), "o_orderpriority").union(quality.accepted_values(t("customer"), "c_name")), "select 'o_orderpriority' column_name, count(distinct o_orderpriority) n_values, max(length(o_orderpriority))::int longest, count(distinct o_orderpriority) between 2 and 20 and max(length(o_orderpriority)) <= 40 proposes from orders union all select 'c_name', count(distinct c_name), max(length(c_name))::int, count(distinct c_name) between 2 and 20 and max(length(c_name)) <= 40 from customer")
register("failing_rows", lambda t: quality.failing_rows({"positive": (t("customer"), F.col("c_acctbal") > 0), "has_name": (t("customer"), F.col("c_name").isNotNull()), "small": (t("part"), F.col("p_size") < 45)}), "select * from (select 'positive' test, count(*) filter (where not coalesce(c_acctbal > 0, false)) n_failed from customer union all select 'has_name', count(*) filter (where c_name is null) from customer union all select 'small', count(*) filter (where not coalesce(p_size < 45, false)) from part) where n_failed > 0")
def _variants(t):
    """Loads of a feed by part: each has its amounts, and those with other units besides got a column for them."""
    part = F.concat("l_returnflag", "l_linestatus", F.col("l_suppkey") % 9)
    read = t("lineitem").select(part.alias("relation"), F.lit("amount").alias("column_name"), F.lit(True).alias("is_read")).distinct()
    other = t("lineitem").where("l_discount > 0.08 and l_tax > 0.07 and l_quantity < 4").select(part.alias("relation"), F.lit("amount__v_text").alias("column_name"), F.lit(False).alias("is_read")).distinct()
    return quality.variant_columns(read.union(other))


register("variant_columns", _variants, "select distinct l_returnflag || l_linestatus || (l_suppkey % 9) relation, 'amount' column_name, 'amount__v_text' variant from lineitem where l_discount > 0.08 and l_tax > 0.07 and l_quantity < 4")
def _costs(t):
    found = {n: t(n) for n in ("customer", "embeddings")}
    counts = reduce(DataFrame.union, [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("relation"), "row_count") for n, df in found.items()])
    return analytics.estimate_bytes(schema_rows(found).join(counts, "relation"), t.spark.createDataFrame([("bigint", 8), ("int", 4), ("double", 8), ("string", 32)], "type string, width int"))


register("cost_estimate", _costs, "select 'customer' relation, (8 + 32 + 4 + 8 + 32) * count(*) bytes from customer union all select 'embeddings', null")

# ---------------------------------------------------------------- monitoring

_DAILY = "select event_type relation, cast(ts as date) bucket, count(*) n from events group by 1, 2"
_daily = lambda t: t("events").groupBy(F.col("event_type").alias("relation"), F.to_date("ts").alias("bucket")).agg(F.count("*").alias("n"))
register("volume_daily", _daily, _DAILY)
register("volume_two_buckets", lambda t: monitor.volume_change(_daily(t)).withColumn("change", r(F.col("change"), 6)), f"""with b as ({_DAILY}), k as (select *, row_number() over (partition by relation order by bucket desc) k, count(*) over (partition by relation) buckets from b)
select relation, max(buckets) buckets, max(n) filter (where k = 1) last_n, max(n) filter (where k = 2) prior_n, round((max(n) filter (where k = 1) - max(n) filter (where k = 2)) / max(n) filter (where k = 2), 6) change, case when max(buckets) = 1 then 'one_bucket' else 'compared' end state from k where k <= 2 group by relation""")
register("volume_rerecorded", lambda t: monitor.latest_buckets(_daily(t).withColumn("updated_at", F.lit(1)).union(_daily(t).withColumn("n", F.col("n") * 2).withColumn("updated_at", F.lit(2)))), f"select relation, bucket, n * 2 n from ({_DAILY})")
_WRITES = "select user_id::varchar relation, ts written_at from events where event_type = 'purchase'"
_writes = lambda t: t("events").where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("relation"), F.col("ts").alias("written_at"))
_CADENCE = f"""with d as (select distinct relation, cast(written_at as date) day_ from ({_WRITES})), g as (select relation, date_diff('day', lag(day_) over (partition by relation order by day_), day_) gap, day_ from d),
k as (select relation, gap, row_number() over (partition by relation order by gap, day_) - 1 rk, count(*) over (partition by relation) n_gaps from g where gap is not null),
c as (select relation, n_gaps, max(gap) filter (where rk = (9 * (n_gaps - 1) + 9) // 10)::int p90 from k group by 1, 2)"""
register("cadence_p90", lambda t: monitor.cadence(_writes(t)).select("relation", "n_gaps", "p90_days", "stale_after"), f"{_CADENCE} select relation, n_gaps, case when n_gaps >= 3 then p90 end p90_days, case when n_gaps >= 3 then greatest(1, p90) end stale_after from c")
register("staleness", lambda t: monitor.stale(_writes(t).groupBy("relation").agg(F.max("written_at").alias("last_at")), monitor.cadence(_writes(t)), "2024-01-31"), f"{_CADENCE}, l as (select relation, max(written_at) last_at from ({_WRITES}) group by 1) select relation, date_diff('day', cast(last_at as date), date '2024-01-31')::int days_old, case when n_gaps >= 3 then greatest(1, p90) end stale_after, date_diff('day', cast(last_at as date), date '2024-01-31') > case when n_gaps >= 3 then greatest(1, p90) end is_stale from l left join c using (relation)")
_results = lambda t: t("events").select((F.col("user_id") % 40).cast("string").alias("test_id"), F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "skipped").otherwise("pass").alias("status"), F.col("ts").alias("ran_at"))
_RESULTS = "select (user_id % 40)::varchar test_id, case when event_type = 'error' then 'fail' when event_type = 'view' then 'skipped' else 'pass' end status, ts ran_at from events"
register("coverage_counts", lambda t: monitor.test_coverage(t.spark.range(50).select(F.col("id").cast("string").alias("test_id")), _results(t)), f"with l as (select test_id, status from ({_RESULTS}) qualify row_number() over (partition by test_id order by ran_at desc, status) = 1) select count(*) n_declared, count(status) n_ran, count(*) filter (where status is null) n_never_run, count(*) filter (where status = 'skipped') n_skipped_last, count(*) filter (where status = 'fail') n_failing_last from (select range::varchar test_id from range(50)) left join l using (test_id)")
register("monitor_states", lambda t: monitor.monitor_state(t("events").select(F.col("event_type").alias("monitor"), F.when(F.col("event_type") != "click", F.col("ts")).alias("run_at")), "2024-02-20", 7).select("monitor", "runs", "state"), "select event_type monitor, count(case when event_type <> 'click' then ts end) runs, case when event_type = 'click' then 'never_run' when date_diff('day', cast(max(ts) as date), date '2024-02-20') > 7 then 'abandoned' else 'live' end state from events group by 1")

# ---------------------------------------------------------------- joins

register("join_semi", lambda t: t("customer").join(t("orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"), "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
register("join_anti", lambda t: t("customer").join(t("orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"), "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
text_query("join_cross", "select r_name, n_name from region cross join nation", "region", "nation")
text_query("join_using", "select n_name, m from nation join (select n_nationkey, n_regionkey * 2 as m from nation) q using (n_nationkey)", "nation")
register("merge_join", lambda t: relops.merge_join(t("nation").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("v")), t("nation").select(F.col("n_nationkey").alias("k"), F.lower("n_name").alias("v"), "n_regionkey"), [("k", "k")]), "select n_nationkey k, coalesce(case when n_nationkey % 2 = 0 then n_name end, lower(n_name)) v, n_regionkey from nation")
register("as_of_pick", lambda t: relops.as_of(t("events").where("event_type = 'purchase'").select("event_id", "user_id", "ts"), t("events").where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id")), ["user_id"], "ts", "click_ts", ["click_id"]).select("event_id", "click_id"), "select a.event_id, b.event_id click_id from (select * from events where event_type = 'purchase') a asof left join (select * from events where event_type = 'click') b on a.user_id = b.user_id and a.ts >= b.ts")
register("range_join", lambda t: relops.range_join(t("part").select("p_partkey", F.col("p_size").cast("double").alias("x")), t("nation").select("n_nationkey", (F.col("n_nationkey") * 2.0).alias("lo"), (F.col("n_nationkey") * 2.0 + 1.5).alias("hi")), "x", "lo", "hi", 5.0).groupBy("n_nationkey").agg(F.count("*").alias("n")), "select n_nationkey, count(*) n from part join nation on p_size between n_nationkey * 2.0 and n_nationkey * 2.0 + 1.5 group by 1")
register("merge_by_key", lambda t: relops.merge_by_key(t("orders").select("o_orderkey", "o_orderstatus").where("o_orderkey % 3 <> 0"), t("orders").where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus")), ["o_orderkey"]), "select o_orderkey, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end o_orderstatus from orders where o_orderkey % 3 <> 0 or o_orderkey % 5 = 0")

# ---------------------------------------------------------------- the dialect: projection, predicates, aggregation, windows, set operations

text_query("case_coalesce_nullif", "select c_custkey, case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'some' else 'much' end as band, case c_nationkey when 1 then 'one' else 'other' end as w, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as seg from customer", "customer")
text_query("like_between_in", "select p_partkey from part where (p_name like '%ring%' and p_size between 5 and 25) or p_brand in ('Brand#1', 'Brand#2') or p_type not in ('ECONOMY', null)", "part")
text_query("ilike_distinct_from", "select p_partkey, p_type is distinct from 'ECONOMY' as other from part where p_name ilike 'RED%' and not (p_size is null)", "part")
text_query("integer_math", "select n_nationkey, n_nationkey / 3 as q, n_nationkey % 4 as m, -n_nationkey as neg, n_nationkey / 0 as z, n_name || '!' as bang from nation", "nation", duck="select n_nationkey, (n_nationkey // 3)::bigint as q, n_nationkey % 4 as m, -n_nationkey as neg, null::bigint as z, n_name || '!' as bang from nation")
text_query("three_valued", "select n_nationkey, (n_nationkey > 5 and null) is null as a, (n_nationkey > 5 or null) is null as b, not (null = n_nationkey) is null as c from nation", "nation")
text_query("in_subquery", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 450000)", "customer", "orders")
text_query("not_in_subquery", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)", "customer", "orders")
text_query("exists_correlated", "select c.c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'F')", "customer", "orders")
text_query("scalar_subquery", "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) * 1.9 from orders)", "orders")
text_query("list_and_lambda", "select n_nationkey, list_contains([1, 2, 3], n_nationkey) as there, [10, 20, 30][2] as second from nation", "nation")
text_query("string_functions", "select c_custkey, substr(c_name, 1, 8) as s, len(c_mktsegment) as n, lower(c_mktsegment) as l, upper(c_name) as u, trim(c_name) as t from customer", "customer", duck="select c_custkey, substr(c_name, 1, 8) as s, len(c_mktsegment)::int as n, lower(c_mktsegment) as l, upper(c_name) as u, trim(c_name) as t from customer")
text_query("date_functions", "select o_orderkey, date_diff('day', date '1995-01-01', cast(o_orderdate as date)) as d, extract(dow from o_orderdate) as dow, extract(year from o_orderdate) as y from orders", "orders", duck="select o_orderkey, date_diff('day', date '1995-01-01', cast(o_orderdate as date))::int as d, extract(dow from o_orderdate)::int as dow, extract(year from o_orderdate)::int as y from orders")
text_query("math_functions", "select p_partkey, pow(p_size, 2) as sq, ceiling(p_retailprice / 7) as c from part", "part", exact=True, duck="select p_partkey, pow(p_size, 2) as sq, ceiling(p_retailprice / 7)::bigint as c from part")
text_query("full_match", "select p_partkey from part where p_name ~ 'red .*'", "part", duck="select p_partkey from part where regexp_full_match(p_name, 'red .*')")
text_query("group_having", "select o_custkey, count(*) as n, sum(o_orderkey) as s, min(o_orderdate) as lo, max(o_orderdate) as hi from orders group by o_custkey having count(*) > 5", "orders", duck="select o_custkey, count(*) as n, sum(o_orderkey)::bigint as s, min(o_orderdate) as lo, max(o_orderdate) as hi from orders group by o_custkey having count(*) > 5")
text_query("group_ordinal", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2", "orders")
text_query("filter_aggregate", "select l_returnflag, count(*) filter (where l_quantity > 25) as n, count(distinct l_suppkey) filter (where l_tax = 0) as d, count(*) - count(*) filter (where l_discount > 0.05) as rest from lineitem group by l_returnflag", "lineitem")
text_query("global_aggregate", "select count(*) as n, count(distinct o_custkey) as d, sum(o_orderkey) as s from orders where o_orderkey < 0", "orders", duck="select count(*) as n, count(distinct o_custkey) as d, sum(o_orderkey)::bigint as s from orders where o_orderkey < 0")
text_query("distinct_tuple", "select count(distinct (l_orderkey, l_linenumber)) as d from lineitem", "lineitem")
text_query("distinct_rows", "select distinct o_orderstatus, o_orderpriority from orders", "orders")
text_query("ordered_listagg", "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by n_regionkey", "nation")
text_query("qualify_pick", "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) = 1", "orders")
text_query("distinct_on", "select distinct on (o_custkey) o_custkey, o_orderkey from orders order by o_custkey, o_totalprice desc, o_orderkey", "orders")
text_query("ranks", "select o_orderkey, rank() over (partition by o_custkey order by o_orderstatus) as rk, dense_rank() over (partition by o_custkey order by o_orderstatus) as dr from orders", "orders", duck="select o_orderkey, (rank() over (partition by o_custkey order by o_orderstatus))::int as rk, (dense_rank() over (partition by o_custkey order by o_orderstatus))::int as dr from orders")
text_query("union_all", "select n_name as x from nation union all select r_name from region", "nation", "region")
text_query("union_distinct", "select n_regionkey as x from nation union select r_regionkey from region", "nation", "region")
text_query("union_by_name", "select n_name as name, n_nationkey as id from nation union all by name select r_regionkey as id, r_name as other from region", "nation", "region")
text_query("top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20", "orders")
register("bag_difference", lambda t: relops.bag_difference(t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k"))).groupBy("k", "side").agg(F.count("*").alias("n")), "with a as (select c_nationkey k, count(*) n from customer group by 1), b as (select s_nationkey k, count(*) n from supplier group by 1), d as (select coalesce(a.k, b.k) k, coalesce(a.n, 0) - coalesce(b.n, 0) x from a full join b on a.k = b.k) select k, case when x > 0 then 'only_a' else 'only_b' end side, abs(x) n from d where x <> 0")
register("rollup", lambda t: t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")), "select l_returnflag, l_linestatus, count(*) n from lineitem group by rollup (l_returnflag, l_linestatus)")
register("cube", lambda t: t("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("m")), "select o_orderstatus, o_orderpriority, count(*) n, max(o_orderkey) m from orders group by cube (o_orderstatus, o_orderpriority)")
register("exact_total", lambda t: t("lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("string").alias("total")), "select l_returnflag, sum(l_extendedprice::decimal(18,2))::varchar total from lineitem group by 1")
register("pricing_summary", lambda t: t("lineitem").where("l_shipdate <= '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(r(F.sum("l_quantity"), 2).alias("sum_qty"), r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), r(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")), "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, round(avg(l_discount), 6) avg_disc, count(*) n from lineitem where l_shipdate <= '1998-09-02' group by 1, 2")
register("pick_latest", lambda t: relops.pick(t("orders"), ["o_custkey"], ["o_orderdate desc", "o_orderkey"]).select("o_custkey", "o_orderkey"), "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) = 1")
register("top_k_per_group", lambda t: relops.pick(t("orders"), ["o_orderpriority"], ["o_totalprice desc", "o_orderkey"], 3).select("o_orderpriority", "o_orderkey"), "select o_orderpriority, o_orderkey from orders qualify row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) <= 3")
register("lag_lead", lambda t: relops.with_neighbours(t("events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], "event_id").select("event_id", "prev_event_id", "next_event_id"), "select event_id, lag(event_id) over w prev_event_id, lead(event_id) over w next_event_id from events window w as (partition by user_id order by ts, event_id)")
register("window_frames", lambda t: t("orders").select("o_orderkey", F.sum("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)).alias("s"), F.last("o_orderstatus", True).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)).alias("was")), "select o_orderkey, (sum(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row))::bigint s, last_value(o_orderstatus ignore nulls) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding) was from orders")
register("pick_ties", lambda t: relops.ties(t("orders"), ["o_custkey"], ["o_orderdate desc"]), "select o_custkey, o_orderdate, count(*) n from orders group by 1, 2 having count(*) > 1")

# ---------------------------------------------------------------- analytics over derived audit tables

_verdicts = lambda t: t("labels").join(t("documents").select("doc_id", "lang", "source", "n_chars"), "doc_id").select(F.col("lang").alias("family"), (F.col("doc_id") % 3).cast("string").alias("prompt_version"), F.col("source").alias("model_version"), F.when(F.col("quality") == 1, F.when(F.col("doc_id") % 4 == 0, "accept").otherwise("agree")).when(F.col("toxic") == 1, "unclear").otherwise("disagree").alias("verdict"), F.col("source").alias("subject"), F.col("lang").alias("question"), F.col("doc_id").alias("decided_at"), F.when(F.col("doc_id") % 2 == 0, "why").alias("note"), (F.col("n_chars") % 100 / 100.0).alias("p"))
_VERDICTS = "v as (select d.lang family, (d.doc_id % 3)::varchar prompt_version, d.source model_version, case when quality = 1 then case when d.doc_id % 4 = 0 then 'accept' else 'agree' end when toxic = 1 then 'unclear' else 'disagree' end verdict, d.source subject, d.lang question, d.doc_id decided_at, case when d.doc_id % 2 = 0 then 'why' end note, d.n_chars % 100 / 100.0 p from labels l join documents d on l.doc_id = d.doc_id)"
_COUNTS = "count(*) n, count(*) filter (where verdict = 'agree') agree, count(*) filter (where verdict = 'accept') accept, count(*) filter (where verdict = 'disagree') disagree, count(*) filter (where verdict = 'unclear') unclear"
register("effectiveness", lambda t: analytics.effectiveness(_verdicts(t)).withColumn("agreement", r(F.col("agreement"), 6)), f"with {_VERDICTS}, c as (select family, prompt_version, model_version, {_COUNTS} from v group by 1, 2, 3) select *, round(case when agree + accept + disagree > 0 then (agree + accept) / (agree + accept + disagree) end, 6) agreement from c")
register("accuracy_by_family", lambda t: analytics.accuracy_by_family(_verdicts(t), t.spark.createDataFrame([("en", "1"), ("fr", "2"), ("xx", "0")], "family string, prompt_version string")).withColumn("agreement", r(F.col("agreement"), 6)), f"with {_VERDICTS}, c as (select family, prompt_version, {_COUNTS} from v group by 1, 2) select family, prompt_version, coalesce(n, 0) n, coalesce(agree, 0) agree, coalesce(accept, 0) accept, coalesce(disagree, 0) disagree, round(case when agree + accept + disagree > 0 then (agree + accept) / (agree + accept + disagree) end, 6) agreement from (values ('en', '1'), ('fr', '2'), ('xx', '0')) s(family, prompt_version) left join c using (family, prompt_version)")
register("open_disagreements", lambda t: analytics.open_disagreements(_verdicts(t)).select("subject", "question", "decided_at"), f"with {_VERDICTS} select subject, question, decided_at from v a where verdict = 'disagree' and note is not null and note <> '' and not exists (select 1 from v b where b.verdict = 'agree' and b.subject = a.subject and b.question = a.question and b.prompt_version <> a.prompt_version and b.decided_at > a.decided_at)")
register("latest_rulings", lambda t: analytics.latest_rulings(_verdicts(t), ["subject", "question"]).select("subject", "question", "verdict"), f"with {_VERDICTS} select subject, question, verdict from v qualify row_number() over (partition by subject, question order by decided_at desc, verdict) = 1")
register("adjudication_counts", lambda t: _verdicts(t).groupBy("family").agg(F.countDistinct(F.struct("subject", "question")).alias("pairs")), f"with {_VERDICTS} select family, count(distinct (subject, question)) pairs from v group by 1")
_calibrated = lambda t: analytics.calibration(_verdicts(t).select("family", "p", F.col("verdict").isin("agree", "accept").alias("agreed")))
_CALIBRATED = f"""with {_VERDICTS}, c as (select family, case when p is null then 'no probability' when p < 0.3 then '<.3' when p < 0.5 then '.3-.5' when p < 0.7 then '.5-.7' else '.7+' end band, count(*) n, count(*) filter (where verdict in ('agree', 'accept')) agree from v group by 1, 2),
w as (select *, round(least(1.0, greatest(0.0, (agree / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(agree / n * (1 - agree / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n))), 4) low, round(least(1.0, greatest(0.0, (agree / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(agree / n * (1 - agree / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n))), 4) high from c)"""
register("calibration_wilson", _calibrated, f"{_CALIBRATED} select * from w")
register("bands_separated", lambda t: analytics.bands_separated(_calibrated(t)), f"{_CALIBRATED} select family, bool_or(sep) separated from (select a.family, a.high < b.low sep from w a join w b on a.family = b.family) group by 1")
_calls = lambda t: t("events").select(F.col("event_id").alias("call_id"), F.col("event_type").alias("caller"), F.when(F.col("user_id") % 9 > 0, F.col("user_id") * 10).alias("tokens"), F.when(F.col("event_id") % 2 == 0, 0.5).otherwise(0.25).alias("usd_per_token"), F.col("ts").alias("at"))
register("ledger_rollup", lambda t: analytics.spend_ledger(_calls(t).union(_calls(t)), ["caller"]), "select event_type caller, count(*) calls, count(*) filter (where user_id % 9 = 0) unmetered, sum(case when user_id % 9 > 0 then user_id * 10 end)::bigint tokens, sum(case when user_id % 9 > 0 then user_id * 10 end * case when event_id % 2 = 0 then 0.5 else 0.25 end)::double usd from events group by 1")
register("warehouse_ledger", lambda t: analytics.warehouse_ledger(t("lineitem").select(F.col("l_linestatus").alias("kind"), (F.col("l_returnflag") == "R").alias("failed"), F.col("l_orderkey").alias("wall_ms"), F.col("l_partkey").alias("exec_ms"), F.col("l_tax").alias("usd")), ["kind"]).withColumn("usd", r(F.col("usd"), 6)), "select l_linestatus kind, count(*) statements, count(*) filter (where l_returnflag = 'R') failures, sum(l_orderkey)::bigint wall_ms, sum(l_partkey)::bigint exec_ms, round(sum(l_tax::decimal(18,2)) filter (where l_returnflag <> 'R')::double, 6) usd from lineitem group by 1")
_findings = lambda t: t("orders").select(F.year("o_orderdate").alias("run_id"), F.col("o_orderpriority").alias("check_name"), F.col("o_custkey").alias("subject"), F.concat_ws("/", "o_orderpriority", "o_custkey").alias("identity"), F.col("o_orderkey").alias("finding_id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderdate").alias("started_at"), F.col("o_totalprice").alias("weight"))
register("trend", lambda t: analytics.trend(_findings(t), ["F", "P"]), "select year(o_orderdate)::int run_id, count(*) filter (where o_orderstatus = 'F') \"n_F\", count(*) filter (where o_orderstatus = 'P') \"n_P\", count(*) n from orders group by 1")
_year = lambda t, y: _findings(t).where(F.col("run_id") == y).select("identity", (F.col("finding_id") % 50).alias("finding_id")).distinct()
_DIFF = """with f as (select distinct year(o_orderdate) y, concat(o_orderpriority, '/', o_custkey) i, o_orderkey % 50 id from orders where year(o_orderdate) in (1997, 1998)), a as (select i, id from f where y = 1997), b as (select i, id from f where y = 1998),
s as (select a.i, a.id was, b.id now from a join b on a.i = b.i and a.id = b.id), ra as (select i, id, row_number() over (partition by i order by id) k from a where (i, id) not in (select i, was from s)), rb as (select i, id, row_number() over (partition by i order by id) k from b where (i, id) not in (select i, was from s))"""
register("run_diff", lambda t: analytics.run_diff(_year(t, 1997), _year(t, 1998)), f"{_DIFF} select i as identity, was was_id, now now_id, 'same' state from s union all select coalesce(ra.i, rb.i), ra.id, rb.id, case when rb.id is null then 'gone' when ra.id is null then 'new' else 'reworded' end from ra full join rb on ra.i = rb.i and ra.k = rb.k")
register("carried_findings", lambda t: analytics.carried_ids(_findings(t).where("run_id = 1998"), _findings(t).where("run_id < 1998")).select("finding_id", F.array_join("earlier", ",").alias("earlier")), "select a.o_orderkey finding_id, string_agg(distinct b.o_orderkey::varchar, ',' order by b.o_orderkey::varchar) earlier from orders a join orders b on a.o_orderpriority = b.o_orderpriority and a.o_custkey = b.o_custkey and year(b.o_orderdate) < 1998 where year(a.o_orderdate) = 1998 group by 1".replace("string_agg(distinct b.o_orderkey::varchar, ',' order by b.o_orderkey::varchar)", "array_to_string(list_sort(list_distinct(list(b.o_orderkey))), ',')"))
register("first_seen", lambda t: analytics.first_seen(_findings(t)).select("identity", "first_at", "runs"), "select concat(o_orderpriority, '/', o_custkey) as identity, min(o_orderdate) first_at, count(distinct year(o_orderdate)) runs from orders group by 1")
_runs = lambda t: _findings(t).groupBy("run_id").agg(F.max("started_at").alias("started_at")).withColumn("project", F.lit("p"))
register("prune_keep_last", lambda t: analytics.prune(_findings(t), _runs(t), 2).groupBy("run_id").agg(F.count("*").alias("n")), "select year(o_orderdate)::int run_id, count(*) n from orders where year(o_orderdate) >= 2000 group by 1")
register("baseline_runs", lambda t: analytics.baseline_runs(_runs(t).withColumn("scope", F.when(F.col("run_id") == 1998, "some"))).select("run_id", "baseline"), "with x as (select distinct year(o_orderdate)::int run_id from orders where year(o_orderdate) <> 1998) select run_id, lag(run_id) over (order by run_id) baseline from x")
register("neighbour_gaps", lambda t: analytics.neighbour_gaps(t("events").groupBy(F.to_date("ts").alias("started_at")).agg(F.count(F.when(F.col("event_type") == "purchase", 1)).alias("n")).withColumn("project", F.lit("p")).withColumn("run_id", F.col("started_at")).withColumn("n", F.when(F.dayofmonth("started_at") % 5 == 0, 1).otherwise(F.col("n")))).select("started_at", "n", "prev_n", "next_n"), "with d as (select cast(ts as date) started_at, case when day(cast(ts as date)) % 5 = 0 then 1 else count(*) filter (where event_type = 'purchase') end n from events group by 1), w as (select *, lag(n) over (order by started_at) prev_n, lead(n) over (order by started_at) next_n from d) select * from w where 2 * n <= prev_n and 2 * n <= next_n")
register("churn", lambda t: analytics.churn(t("orders").select(F.col("o_orderkey").alias("sha"), F.array(F.concat(F.lit("m"), F.col("o_custkey") % 40), F.concat(F.lit("m"), F.col("o_orderkey") % 7)).alias("models")), 10), "select model, count(distinct o_orderkey) commits from (select o_orderkey, unnest(['m' || (o_custkey % 40), 'm' || (o_orderkey % 7)]) model from orders) group by 1 order by 2 desc, 1 limit 10")
register("stale_answers", lambda t: analytics.stale_answers(t("orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("question"), F.col("o_orderkey").alias("decided_at"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("checksum")), t("customer").where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("subject"), F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("O").alias("checksum"))).groupBy("state").agg(F.count("*").alias("n")), "with l as (select o_custkey, case when o_orderstatus <> 'P' then o_orderstatus end checksum from orders qualify row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey desc) = 1), j as (select checksum, case when c_nationkey is null then null when c_nationkey % 2 = 0 then 'F' else 'O' end now from l left join (select * from customer where c_custkey % 4 > 0) on o_custkey = c_custkey) select case when checksum is null or now is null then 'uncheckable' when checksum <> now then 'moved' else 'current' end state, count(*) n from j group by 1")
register("premise_changes", lambda t: analytics.premise_changes(_observed(t).select(F.col("column_name").alias("premise_id"), F.col("observed_at").alias("run_at"), "status")), f"with {_OBSERVED_SQL}, w as (select column_name premise_id, observed_at since, lag(status) over (partition by column_name order by observed_at) was, status now from observed) select * from w where was is not null and was <> now")
register("fixed_and_returned", lambda t: analytics.fixed_and_returned(_findings(t).where("run_id = 1995").select("identity", F.lit(1995).alias("agreed_in")).distinct(), _findings(t).select("identity", F.col("run_id").alias("run_no")), _findings(t).select(F.col("run_id").alias("run_no")).distinct()).groupBy("state").agg(F.count("*").alias("n")), "with f as (select distinct concat(o_orderpriority, '/', o_custkey) i, year(o_orderdate) y from orders), g as (select a.i, r.y, exists (select 1 from f b where b.i = a.i and b.y = r.y) there from (select i from f where y = 1995) a join (select distinct y from f) r on r.y > 1995), s as (select i, min(y) filter (where not there) gone, max(y) filter (where there) last_there, max(y) last_no from g group by 1) select case when gone is null then 'open' when last_there > gone then 'returned' when coalesce(last_there, -1) < last_no then 'fixed' else 'open' end state, count(*) n from s group by 1")
register("group_findings", lambda t: analytics.group_findings(_findings(t).withColumn("shape", F.col("kind"))), "select o_orderpriority check_name, o_orderstatus shape, count(distinct o_custkey) subjects from orders group by 1, 2 having count(distinct o_custkey) >= 2")
register("check_rollup", lambda t: analytics.check_rollup(_findings(t).withColumn("marts", F.col("subject") % 7)).withColumn("mean_weight", r(F.col("mean_weight"), 2)), "select o_orderpriority check_name, count(*) findings, count(distinct o_custkey) models, round(avg(o_totalprice), 2) mean_weight, max(o_custkey % 7) worst_reach from orders group by 1")
register("gate_verdict", lambda t: analytics.gate_verdict(t("nation").select(F.col("n_name").alias("part"), F.when(F.col("n_nationkey") == 3, "fail").when(F.col("n_nationkey") % 2 == 0, "skipped").otherwise("pass").alias("outcome"))), "select count(*) filter (where n_nationkey = 3) failed, count(*) filter (where n_nationkey <> 3 and n_nationkey % 2 = 0) skipped, count(*) filter (where n_nationkey <> 3 and n_nationkey % 2 = 1) passed, 'fail' verdict from nation")
register("action_policy", lambda t: analytics.action_policy(_verdicts(t).withColumn("seen", F.length("subject")), {"fail": "p >= 0.9", "queue": "p >= 0.5 and p < 0.9", "annotate": "p >= 0.2"}, F.col("seen"), F.lit(None).cast("double"), 5, 0.8).groupBy("action").agg(F.count("*").alias("n")), f"with {_VERDICTS}, a as (select case when p >= 0.9 then case when length(subject) < 5 then 'queue' else 'fail' end when p >= 0.5 and p < 0.9 then 'queue' when p >= 0.2 then 'annotate' end as action from v) select action, count(*) n from a group by 1")
register("vocabulary", lambda t: analytics.vocabulary(t("orders").select(F.col("o_orderpriority").alias("model"), F.array(F.concat(F.lit("k"), F.col("o_custkey") % 90), F.lit("id")).alias("joined_on")), t.spark.createDataFrame([("id",)], "term string"), 20, 4), "select 'k' || (o_custkey % 90) term, count(*) hops, count(distinct o_orderpriority) models from orders group by 1 having count(*) >= 20 and count(distinct o_orderpriority) >= 4")
register("repeated_reasons", lambda t: analytics.repeated_reasons(t("part").select(F.upper("p_name").alias("reason"), F.col("p_brand").alias("subject"))), "select trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) reason, count(distinct p_brand) subjects from part group by 1 having count(distinct p_brand) >= 2")

# ---------------------------------------------------------------- graph: customers and suppliers hang on nations, nations on regions

_nodes = lambda t: t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("source").alias("kind")).union(t("nation").select(F.concat(F.lit("n"), "n_nationkey"), F.lit("model"))).union(t("supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.lit("mart")))
_edges = lambda t: t("nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst")).union(t("supplier").select(F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("s"), "s_suppkey")))
_GRAPH = "e as (select 'r' || n_regionkey src, 'n' || n_nationkey dst from nation union all select 'n' || s_nationkey, 's' || s_suppkey from supplier), v as (select 'r' || r_regionkey node, 'source' kind from region union all select 'n' || n_nationkey, 'model' from nation union all select 's' || s_suppkey, 'mart' from supplier), c as (select src node, dst reached, 1 hops from e union select c.node, e.dst, c.hops + 1 from c join e on c.reached = e.src)"
register("descendants", lambda t: graph.closure(_edges(t)), f"with recursive {_GRAPH} select node, reached, min(hops)::int hops from c group by 1, 2")
register("blast_radius", lambda t: graph.blast_radius(_nodes(t), _edges(t)), f"with recursive {_GRAPH} select v.node, count(distinct reached) descendants, count(distinct reached) filter (where k.kind = 'mart') marts, 0::bigint exposures from v left join c on v.node = c.node left join v k on k.node = c.reached group by 1")
register("components", lambda t: graph.components(_nodes(t), _edges(t)), "with m as (select n_regionkey g, least('r' || n_regionkey, min('n' || n_nationkey), coalesce(min('s' || s_suppkey), 'z')) component from nation left join supplier on s_nationkey = n_nationkey group by n_regionkey) select node, component from (select r_regionkey g, 'r' || r_regionkey node from region union all select n_regionkey, 'n' || n_nationkey from nation union all select n_regionkey, 's' || s_suppkey from supplier join nation on s_nationkey = n_nationkey) join m using (g)")
register("topological_levels", lambda t: graph.levels(_nodes(t), _edges(t)), f"with recursive {_GRAPH} select v.node, coalesce(max(hops), 0)::int as level from v left join c on c.reached = v.node group by 1")
register("sources_behind", lambda t: graph.sources_behind(_nodes(t), _edges(t)).select("node", F.array_join("sources", ",").alias("sources")), f"with recursive {_GRAPH} select reached node, string_agg(distinct c.node, ',') sources from c join v on v.node = c.node where v.kind = 'source' group by 1")
register("reach_stopping", lambda t: graph.reaches_until(_nodes(t).where("kind = 'source'"), _edges(t), _nodes(t).where("node in ('n1', 'n2', 'n3')").select("node"), _nodes(t).where("kind = 'mart'")), "select 'r' || n_regionkey node, count(*) goals from supplier join nation on s_nationkey = n_nationkey where n_nationkey not in (1, 2, 3) group by 1")
register("coverage_closure", lambda t: monitor.coverage_closure(_nodes(t).select("node", F.col("node").isin("r0", "r1").alias("monitored"), F.lit(False).alias("is_seed")), _edges(t), 3).groupBy("covered").agg(F.count("*").alias("n")), "select covered, count(*) n from (select r_regionkey in (0, 1) covered from region union all select n_regionkey in (0, 1) from nation union all select n_regionkey in (0, 1) from supplier join nation on s_nationkey = n_nationkey) group by 1")
register("edge_facts", lambda t: graph.edge_facts(_edges(t), _nodes(t).select("node", F.when(F.col("kind") == "source", F.array(*[F.lit(x) for x in "abcdef"])).when(F.col("kind") == "model", F.array(F.lit("a"), F.lit("z"))).otherwise(F.array(F.lit("z"))).alias("cols"))), "select 'r' || n_regionkey src, 'n' || n_nationkey dst, 6 available, 1 carried, 5 dropped, true narrow from nation union all select 'n' || s_nationkey, 's' || s_suppkey, 2, 1, 1, false from supplier")
register("column_trace", lambda t: graph.column_trace(_edges(t).select(F.col("dst").alias("node"), F.lit("id").alias("column"), F.col("src").alias("parent"), F.lit("id").alias("parent_column"), (F.substring("src", 1, 1) != "r").alias("is_carried")), _nodes(t).where("kind = 'mart'").select("node", F.lit("id").alias("column"))).groupBy("hop").agg(F.count("*").alias("n")), "select 0 hop, count(*) n from supplier union all select 1, count(*) from supplier")
register("alignment_jaccard", lambda t: graph.alignment_pairs(t("part").select(F.col("p_name").alias("name")), 0.3), """with n as (select distinct p_name name, list_distinct(string_split_regex(lower(p_name), '[^a-z0-9]+')) t from part), p as (select a.name name_a, b.name name_b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) score from n a join n b on a.name < b.name) select * from p where score >= 0.3""")
register("meaning_diff", lambda t: graph.meaning_diff(t("nation").where("n_nationkey < 20").select(F.col("n_name").alias("subject"), F.col("n_regionkey").alias("value")), t("nation").where("n_nationkey > 3").select(F.col("n_name").alias("subject"), F.when(F.col("n_nationkey") % 5 == 0, 9).otherwise(F.col("n_regionkey")).alias("value"))), "select case when n_nationkey <= 3 then 'removed' when n_nationkey >= 20 then 'added' else 'moved' end as event, n_name subject, case when n_nationkey < 20 then n_regionkey end was, case when n_nationkey > 3 then case when n_nationkey % 5 = 0 then 9 else n_regionkey end end now from nation where n_nationkey <= 3 or n_nationkey >= 20 or (n_nationkey % 5 = 0 and n_regionkey <> 9)")
register("rejoined_concepts", lambda t: graph.rejoined(_edges(t).union(t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).where("s_suppkey % 3 = 0").select(F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("s"), "s_suppkey")))), "select 'r' || n_regionkey a, 'n' || n_nationkey b, 's' || s_suppkey c from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 3 = 0")
register("selector", lambda t: graph.select_nodes(_nodes(t).select("node", F.lit("models/x.sql").alias("path"), F.array("kind").alias("tags"), F.lit("view").alias("materialized")), _edges(t), "r1+ tag:source", "r0"), "select 'r' || r_regionkey node from region where r_regionkey <> 0 union select 'n' || n_nationkey from nation where n_regionkey = 1 union select 's' || s_suppkey from supplier join nation on s_nationkey = n_nationkey where n_regionkey = 1")

# ---------------------------------------------------------------- planning

_counted = lambda t: t("part").where("p_partkey % 4 > 0").select(F.col("p_brand").alias("relation"), F.col("p_partkey").alias("column_key"), (F.col("p_size") % 3).alias("fingerprint"), F.make_date(F.lit(2024), F.lit(1), (F.col("p_size") % 28 + 1).cast("int")).alias("counted_at"))
register("recount_due", lambda t: planning.recount_due(t("part").select(F.col("p_brand").alias("relation"), F.col("p_partkey").alias("column_key"), (F.col("p_size") % 2).alias("fingerprint")), _counted(t), "2024-01-20").select("column_key", "why"), "select * from (select p_partkey column_key, case when p_partkey % 4 = 0 then 'new' when p_size % 2 <> p_size % 3 then 'moved' when date_diff('day', make_date(2024, 1, p_size % 28 + 1), date '2024-01-20') >= 7 then 'old' end why from part) where why is not null")
register("row_count_lookup", lambda t: planning.row_counts(_observed(t).withColumnRenamed("n", "row_count")), f"with {_OBSERVED_SQL} select relation, max(n) row_count from (select * from observed qualify row_number() over (partition by relation, column_name order by observed_at desc) = 1) group by 1")
register("finding_rank", lambda t: planning.ranked_findings(_nodes(t).select(F.lit("c").alias("check_name"), F.col("node").alias("subject"), F.lit(2).alias("base")), graph.blast_radius(_nodes(t), _edges(t))).select("subject", "weight"), f"with recursive {_GRAPH}, b as (select v.node, count(distinct reached) d, count(distinct reached) filter (where k.kind = 'mart') m from v left join c on v.node = c.node left join v k on k.node = c.reached group by 1) select node subject, round(2 * (1 + least(d, 50) / 25 + least(m, 10) / 5), 6) weight from b")
register("priority_rank", lambda t: planning.priority(t("customer").select(F.col("c_mktsegment").alias("check_name"), F.col("c_custkey").alias("subject"), F.when(F.col("c_acctbal") > 9000, F.col("c_acctbal")).otherwise(0.0).alias("costs"), (F.col("c_nationkey") % 5 == 0).alias("harms"), (F.col("c_custkey") % 3).alias("marts"))).groupBy("tier").agg(F.count("*").alias("n")), "select case when c_acctbal > 9000 then 0 when c_nationkey % 5 = 0 then 1 when c_custkey % 3 > 0 then 2 else 3 end tier, count(*) n from customer group by 1")
register("key_from_answers", lambda t: planning.key_from_answers(t("part").select(F.col("p_brand").alias("model"), F.col("p_name").alias("column_name"), F.when(F.col("p_size") % 5 > 0, F.col("p_size") / 50.0).alias("p"))).select("model", F.array_join("key", "|").alias("key"), F.array_join("uncertain", "|").alias("uncertain")), "with a as (select p_brand model, p_name c, case when p_size % 5 > 0 then p_size / 50.0 end p from part), k as (select model, list_sort(list(distinct c) filter (where p is null or p > 0.35)) k, list_sort(list(distinct c) filter (where p > 0.35 and p < 0.70)) u, list_sort(list(distinct c)) e from a group by 1) select model, array_to_string(coalesce(k, e), '|') as key, coalesce(array_to_string(u, '|'), '') uncertain from k")
register("unwatched_models", lambda t: planning.unwatched(graph.blast_radius(_nodes(t), _edges(t)), t("nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))).select("node", "marts"), f"with recursive {_GRAPH} select v.node, count(distinct reached) filter (where k.kind = 'mart') marts from v left join c on v.node = c.node left join v k on k.node = c.reached where v.node not in (select 'n' || n_nationkey from nation where n_nationkey % 2 = 0) group by 1 having count(distinct reached) filter (where k.kind = 'mart') >= 1")
register("orphan_states", lambda t: t("customer").select(F.col("c_custkey").alias("state")).join(t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("state")), "state", "left_anti"), "select c_custkey as state from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
_JOINED = (("a", "left", "customer", "c_custkey"), ("b", "inner", "orders", "o_custkey"), ("c", "inner", "orders", "o_orderkey"), ("d", "left", "customer", "c_nationkey"), ("e", "left", "nation", "n_name"))


def _obligations(t):
    joins = t.spark.createDataFrame([(m, kind, relation, [key]) for m, kind, relation, key in _JOINED], "model string, kind string, relation string, right_keys array<string>")
    scans = quality.key_scan_batch({n: (t(n), [key for _, _, relation, key in _JOINED if relation == n]) for n in ("customer", "orders", "nation")})
    unique = scans.where("status = 'unique'").select("relation", F.array("column_name").alias("columns"))
    return planning.obligations(joins, unique, None)


register("obligations", _obligations, " union all ".join(f"select '{m}' model, '{'left_join_preserves_rows' if kind == 'left' else 'inner_join_no_fanout'}' as rule, 'unique {n} {key}' premise, count({key}) = count(*) and count(distinct {key}) = count(*) have from {n}" for m, kind, n, key in _JOINED))
register("score_stub", lambda t: planning.judged(t("part").select(F.concat_ws(" ", "p_name", "p_type").alias("state")), "same_concept", "align.v1"))
register("grain_routes", lambda t: planning.grain_candidates(digest.digest_texts(t.spark, PROJECT), t.spark.createDataFrame([("stg_orders", ["order_id"])], "node string, key array<string>")).select("model", "route", F.array_join("key", ",").alias("key")))
register("probe_targets", lambda t: planning.probe_targets(digest.digest_texts(t.spark, PROJECT), schema_rows({n: t(n) for n in ("orders", "customer", "nation")})))

# ---------------------------------------------------------------- joins, projections, sets and pairs over whole tables

_cn = lambda t: (t("customer"), t("nation").where("n_regionkey > 0"))
for _how, _kind in (("inner", "join"), ("left", "left join"), ("right", "right join"), ("full", "full join")):
    register(f"join_{_how}", lambda t, h=_how: _cn(t)[0].join(_cn(t)[1], F.col("c_nationkey") == F.col("n_nationkey"), h).select("c_custkey", "n_name"), f"select c_custkey, n_name from customer {_kind} (select * from nation where n_regionkey > 0) on c_nationkey = n_nationkey")
text_query("select_exclude", "select * exclude (c_acctbal, c_name) from customer", "customer")
text_query("cast_try_cast", "select o_orderkey, cast(o_totalprice as bigint) as whole, try_cast(o_orderpriority as int) as bad from orders", "orders")
text_query("cte_chain", "with big as (select * from orders where o_totalprice > 300000), per as (select o_custkey, count(*) as n from big group by o_custkey) select c_name, n from customer left join per on c_custkey = o_custkey", "customer", "orders")
register("except_rows", lambda t: t("customer").select(F.col("c_nationkey").alias("k")).subtract(t("supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("k"))), "select c_nationkey k from customer except select s_nationkey from supplier where s_acctbal < 0")
register("intersect_rows", lambda t: t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select(F.col("s_nationkey").alias("k"))), "select c_nationkey k from customer intersect select s_nationkey from supplier")
register("spend_days", lambda t: analytics.spend_days(t("events").where("event_type = 'purchase'").select(F.col("ts").alias("at")), t("events").where("event_type = 'click' and value > 50").select(F.col("ts").alias("at")), t("events").where("event_type = 'error'").select(F.col("ts").alias("at"))), "with a as (select cast(ts as date) d, count(*) filter (where event_type = 'purchase') runs, count(*) filter (where event_type = 'click' and value > 50) calls, count(*) filter (where event_type = 'error') statements from events group by 1) select d as day, runs, calls, statements, case when calls = 0 and runs > 0 then 'ran without asking' when calls = 0 then 'counted only' end reason from a where runs + calls + statements > 0")
register("reason_pairs", lambda t: planning.reason_pairs(t("part").select(F.col("p_brand").alias("family"), F.col("p_name").alias("reason"), F.col("p_partkey").alias("id")), 200), "with d as (select p_brand family, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) reason, min(p_partkey) id from part group by 1, 2) select a.family, a.id id_a, b.id id_b from d a join d b on a.family = b.family and a.id < b.id order by 1, 2, 3 limit 200")
register("claim_pairs", lambda t: planning.claim_pairs(t("part").select(F.col("p_partkey").alias("claim_id"), F.col("p_brand").alias("subject"), F.concat_ws(" ", "p_name", "p_type", F.lit("made in"), F.col("p_size") % 7).alias("text")), 0.7, 150), """
with c as (select p_partkey id, p_brand subject, list_distinct(list_filter(string_split_regex(lower(p_name || ' ' || p_type || ' made in ' || (p_size % 7)), '[^a-z0-9]+'), lambda x: x <> '')) w from part),
p as (select a.id id_a, b.id id_b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) score from c a join c b on a.id < b.id and a.subject <> b.subject where len(a.w) >= 3 and len(b.w) >= 3)
select id_a, id_b, score from p where score >= 0.7 and score < 1 order by score desc, id_a, id_b limit 150""")

# ---------------------------------------------------------------- laws counted on data


def _repeated(table: str, *keys: str) -> str:
    """SQL: how many defined keys more than one row holds."""
    held = " and ".join(f"{k} is not null" for k in keys)
    return f"(select count(*) from (select 1 from {table} q where {held} group by {', '.join(keys)} having count(*) > 1))"


def _nulls(table: str, *columns: str) -> str:
    return f"(select count(*) from {table} q where {' or '.join(f'{c} is null' for c in columns)})"


def _rows(table: str) -> str:
    return f"(select count(*) from {table} q)"


def _rule(name: str, build: Build, premise: str, conclusion: str, rule: str | None = None) -> None:
    """``premise`` and ``conclusion`` are SQL counts of exceptions."""
    register(f"rule_{name}", build, f"with e as (select {premise} p, {conclusion} c) select '{rule or name}' as rule, p = 0 as premise, c = 0 as conclusion, p = 0 and c <> 0 as violated from e")


_INNER, _LEFT = ("(select * from orders {} join customer on o_custkey = c_custkey)".format(how) for how in ("", "left"))
_FANNED, _FANNED_LEFT = ("(select * from customer {} join orders on c_custkey = o_custkey)".format(how) for how in ("", "left"))
_DEAR = "(select * from orders where o_totalprice > 1000)"
_GRAIN = f"{_repeated('orders', 'o_orderkey')} + {_nulls('orders', 'o_orderkey')} + {_repeated('customer', 'c_custkey')}"
_OC = [("o_custkey", "c_custkey")]
_rule("inner_join_no_fanout", lambda t: rules.inner_join_no_fanout(t("orders"), t("customer"), _OC), _repeated('customer', 'c_custkey'), f"greatest({_rows(_INNER)} - {_rows('orders')}, 0)")
_rule("inner_join_fans_out", lambda t: rules.inner_join_no_fanout(t("customer"), t("orders"), [("c_custkey", "o_custkey")]), _repeated('orders', 'o_custkey'), f"greatest({_rows(_FANNED)} - {_rows('customer')}, 0)", "inner_join_no_fanout")
_rule("left_join_preserves_rows", lambda t: rules.left_join_preserves_rows(t("orders"), t("customer"), _OC), _repeated('customer', 'c_custkey'), f"abs({_rows(_LEFT)} - {_rows('orders')})")
_rule("grain_through_inner_join", lambda t: rules.grain_through_join(t("orders"), t("customer"), _OC, ["o_orderkey"]), _GRAIN, _repeated(_INNER, 'o_orderkey'))
_rule("grain_through_left_join", lambda t: rules.grain_through_join(t("orders"), t("customer"), _OC, ["o_orderkey"], "left"), _GRAIN, _repeated(_LEFT, 'o_orderkey'))
_rule("not_null_through_inner_join", lambda t: rules.not_null_through_join(t("orders"), t("customer"), _OC, ["o_orderkey"]), _nulls('orders', 'o_orderkey'), _nulls(_INNER, 'o_orderkey'))
_rule("not_null_through_left_join", lambda t: rules.not_null_through_join(t("orders"), t("customer"), _OC, ["o_orderkey"], "left"), _nulls('orders', 'o_orderkey'), _nulls(_LEFT, 'o_orderkey'))
_rule("filter_preserves_unique", lambda t: rules.filter_preserves_unique(t("orders"), ["o_orderkey"], F.col("o_totalprice") > 1000), _repeated('orders', 'o_orderkey'), _repeated(_DEAR, 'o_orderkey'))
_rule("not_null_through_filter", lambda t: rules.not_null_through_filter(t("orders"), ["o_orderkey"], F.col("o_totalprice") > 1000), _nulls('orders', 'o_orderkey'), _nulls(_DEAR, 'o_orderkey'))
_rule("group_by_unique", lambda t: rules.group_by_unique(t("lineitem"), ["l_orderkey", "l_partkey"]), "0", _repeated('(select l_orderkey, l_partkey, count(*) n from lineitem group by 1, 2)', 'l_orderkey', 'l_partkey'))
_rule("not_null_through_group_by", lambda t: rules.not_null_through_group_by(t("lineitem"), ["l_orderkey"]), _nulls('lineitem', 'l_orderkey'), _nulls('(select l_orderkey, count(*) n from lineitem group by 1)', 'l_orderkey'))
_rule("pick_unique", lambda t: rules.pick_unique(t("orders"), ["o_custkey"], ["o_orderdate desc", "o_orderkey"]), "0", _repeated('(select * from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) = 1)', 'o_custkey'))
_rule("not_null_through_pick", lambda t: rules.not_null_through_pick(t("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_custkey", "o_orderkey"]), _nulls('orders', 'o_custkey', 'o_orderkey'), _nulls('(select * from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1)', 'o_custkey', 'o_orderkey'))
_rule("pick_is_order_independent", lambda t: rules.pick_is_order_independent(t("orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"]), _repeated('orders', 'o_custkey', 'o_orderdate', 'o_orderkey'), _repeated('(select distinct o_custkey, o_orderdate, o_orderkey from orders qualify rank() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1)', 'o_custkey'))
_rule("join_onto_grouped", lambda t: rules.join_onto_grouped(t("orders"), t("lineitem"), [("o_orderkey", "l_orderkey")]), "0", f"greatest({_rows('(select * from orders join (select l_orderkey, count(*) n from lineitem group by 1) on o_orderkey = l_orderkey)')} - {_rows('orders')}, 0)")
_rule("join_onto_picked", lambda t: rules.join_onto_picked(t("orders"), t("lineitem"), [("o_orderkey", "l_orderkey")], ["l_linenumber", "l_partkey"]), "0", f"greatest({_rows('(select * from orders join (select * from lineitem qualify row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) = 1) on o_orderkey = l_orderkey)')} - {_rows('orders')}, 0)")
_FIRST, _BATCH = "(select o_orderkey, o_orderstatus from orders where o_orderkey % 3 > 0)", "(select o_orderkey, 'X' as o_orderstatus from orders where o_orderkey % 4 = 0)"
_MERGED = f"select o_orderkey, o_orderstatus from {_BATCH} union all select o_orderkey, o_orderstatus from {_FIRST} f where not exists (select 1 from {_BATCH} b where b.o_orderkey = f.o_orderkey)"
_REBUILT = f"select o_orderkey, o_orderstatus from (select *, 0 as b from {_FIRST} union all select *, 1 from {_BATCH}) qualify row_number() over (partition by o_orderkey order by b desc) = 1"
_KEYED = " + ".join(f(x, "o_orderkey") for f in (_repeated, _nulls) for x in (_FIRST, _BATCH))
_rule("incremental_equals_full_refresh", lambda t: rules.incremental_equals_full_refresh(t("orders").where("o_orderkey % 3 > 0").select("o_orderkey", "o_orderstatus"), t("orders").where("o_orderkey % 4 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus")), ["o_orderkey"]), _KEYED, f"{_rows(f'({_MERGED} except all ({_REBUILT}))')} + {_rows(f'(({_REBUILT}) except all ({_MERGED}))')}")
# The same laws where a premise does not hold.
_rule("left_join_multiplies_rows", lambda t: rules.left_join_preserves_rows(t("customer"), t("orders"), [("c_custkey", "o_custkey")]), _repeated("orders", "o_custkey"), f"abs({_rows(_FANNED_LEFT)} - {_rows('customer')})", "left_join_preserves_rows")
_rule("grain_lost_in_a_join", lambda t: rules.grain_through_join(t("customer"), t("orders"), [("c_custkey", "o_custkey")], ["c_custkey"]), f"{_repeated('customer', 'c_custkey')} + {_nulls('customer', 'c_custkey')} + {_repeated('orders', 'o_custkey')}", _repeated(_FANNED, "c_custkey"), "grain_through_inner_join")
_rule("filter_on_a_repeated_key", lambda t: rules.filter_preserves_unique(t("orders"), ["o_custkey"], F.col("o_totalprice") > 1000), _repeated("orders", "o_custkey"), _repeated(_DEAR, "o_custkey"), "filter_preserves_unique")

# ---------------------------------------------------------------- digests, checks, samples and streams (rows only)

#: A small project over the driver's tables, read by the digest queries.
PROJECT = {
    "stg_orders": "select o_orderkey as order_id, o_custkey as customer_id, coalesce(o_totalprice, 0) as amount from orders",
    "int_customer_orders": "with o as (select * from stg_orders where amount > 0) select customer_id, count(*) as n, sum(amount) as total from o group by 1",
    "customers": "select c.c_custkey, c.c_name, t.n, t.total from customer c left join int_customer_orders t on c.c_custkey = t.customer_id where t.n > 1",
    "latest": "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc) = 1",
    "recent": "select * from orders where o_orderdate > current_date limit 5",
    "names": "select n_regionkey, string_agg(n_name, ',') as names from nation where lower(n_name) like 'n%' group by n_regionkey",
    "outside": "select * from a lateral view explode(b) c",
}
register("digest_facts", lambda t: digest.digest_texts(t.spark, PROJECT).select("model", "readable", "reason", F.to_json("relations").alias("relations"), F.to_json("outputs").alias("outputs"), F.to_json("roots").alias("roots"), "unique_kind", F.to_json("patterns").alias("patterns")))
register("predicate_shapes", lambda t: checks.predicate_clusters(digest.digest_texts(t.spark, {**PROJECT, "again": "select 1 as x from stg_orders where amount > 0", "third": "select 2 as x from stg_orders where total > 0"})))
register("project_checks", lambda t: checks.run_all({"digests": digest.digest_texts(t.spark, PROJECT)})[0])
register("sampled_key_scan", lambda t: quality.settled_unique(quality.key_scan(percentage_sample(t("orders"), 50, 3), "orders", ["o_orderkey"]), sampled=True))
register("labelled_batch", lambda t: stringify_batch({"region": t("region"), "nation": t("nation").select("n_name")}))


def _stream(t):
    from .streaming import volume_buckets

    return volume_buckets(t("events"), "ts", "event_type")


register("stream_windows", _stream, "select event_type relation, date_trunc('day', ts)::timestamp bucket, count(*) n from events group by 1, 2")


def _session_rows(t):
    from .streaming import sessions

    return sessions(t("events"), "ts", "user_id", "6 hours").select("key", "started", "n")


register("stream_sessions", _session_rows, "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end new_ from events), s as (select *, sum(new_) over (partition by user_id order by ts rows unbounded preceding) k from g) select user_id as key, min(ts) started, count(*) n from s group by user_id, k")

# ---------------------------------------------------------------- joins counted as a chain, with a hot key


def _chain(t, hows: tuple[str, str, str]):
    orders = t("orders").withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(F.col("o_custkey"))).where("o_totalprice > 50000")
    hops = [
        chains.Hop("orders", orders, "customer", (("c_custkey", "o_custkey"),), hows[0]),
        chains.Hop("lineitem", t("lineitem").where("l_quantity > 20"), "orders", (("o_orderkey", "l_orderkey"),), hows[1]),
        chains.Hop("part", t("part").where("p_size > 10"), "lineitem", (("l_partkey", "p_partkey"),), hows[2]),
        chains.Hop("nation", t("nation"), "customer", (("c_nationkey", "n_nationkey"),)),
    ]
    return chains.chain_sizes("customer", t("customer"), hops).withColumn("ratio", r(F.col("ratio"), 6))


def _chain_sql(hows: tuple[str, str, str]) -> str:
    joins = [
        ("orders", f"{hows[0]} join o on c_custkey = k"), ("lineitem", f"{hows[1]} join l on o_orderkey = l_orderkey"),
        ("part", f"{hows[2]} join p on l_partkey = p_partkey"), ("nation", "join nation on c_nationkey = n_nationkey"),
    ]
    steps = " union all ".join(f"select {k} step, '{([('customer', '')] + joins)[k][0]}' relation, count(*) n_after from customer {' '.join(j for _, j in joins[:k])}" for k in range(5))
    return f"""
with o as (select o_orderkey, case when o_orderkey % 3 = 0 then 1 else o_custkey end k from orders where o_totalprice > 50000),
l as (select l_orderkey, l_partkey from lineitem where l_quantity > 20), p as (select p_partkey from part where p_size > 10),
n as ({steps}), w as (select *, lag(n_after) over (order by step) n_before from n)
select step, relation, n_before, n_after, round(n_after / n_before, 6) ratio, case when n_after > n_before then 'fans_out' when n_after < n_before then 'drops' else 'keeps' end verdict from w where step > 0"""


for _name, _hows in (("inner", ("inner", "inner", "inner")), ("left", ("left", "left", "left")), ("mixed", ("left", "left", "inner"))):
    register(f"chain_sizes_{_name}", lambda t, h=_hows: _chain(t, h), _chain_sql(_hows))

# ---------------------------------------------------------------- streams with late and repeated rows, in four arrivals

_SPANS = 4


def _deliveries(t):
    """Events that arrive up to two hours late, every seventh of them again half an hour later."""
    events = t("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    first = events.withColumn("arrived_at", F.timestamp_micros(F.unix_micros("ts") + F.col("event_id") * 7919 % 7200 * 1000000))
    return first.union(first.where("event_id % 7 = 0").withColumn("arrived_at", F.timestamp_micros(F.unix_micros("arrived_at") + 1800 * 1000000)))


_DELIVERIES = f"""e as (select event_id, ts, user_id, event_type, value, ts + to_seconds(event_id * 7919 % 7200) arrived_at from events),
d as (select * from e union all select * replace (arrived_at + interval 30 minutes as arrived_at) from e where event_id % 7 = 0),
w as (select max(epoch_us(ts)) - 1000000 * (1 + max(epoch_us(arrived_at) // 1000000 - epoch_us(ts) // 1000000)) as mark, min(epoch_us(arrived_at)) lo, max(epoch_us(arrived_at)) hi from d),
x as (select d.*, least({_SPANS - 1}, ((epoch_us(arrived_at) - lo) * {_SPANS} / (hi - lo + 1))::double // 1) span from d, w)"""


def _closed(t):
    rows, out = _deliveries(t), shared_folder(t.spark, "closed-buckets")
    delay = late.measured_delay(rows, "ts", "arrived_at")
    late.in_arrivals(rows, "arrived_at", _SPANS, lambda s: late.closed_buckets(late.without_redelivery(s, "ts", ["event_id"], delay), "ts", "event_type", "1 day"), lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}"))
    return t.spark.read.parquet(out).select("relation", "bucket", "n")


register("stream_closed_buckets", _closed, f"""
with {_DELIVERIES}
select event_type relation, date_trunc('day', ts)::timestamp bucket, count(distinct event_id) n from d, w group by 1, 2, mark having epoch_us(date_trunc('day', ts)::timestamp + interval 1 day) <= mark""")


def _punctual(t):
    rows, out = _deliveries(t), shared_folder(t.spark, "punctuality")
    delay = late.measured_delay(rows, "ts", "arrived_at")
    with late.rocksdb_state(t.spark):
        late.in_arrivals(rows, "arrived_at", _SPANS, lambda s: late.punctuality(s.withWatermark("ts", f"{delay} seconds"), "ts", "arrived_at", "event_type", 86400), lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}"))
    return t.spark.read.parquet(out).select("relation", "ends", "n", "n_late", "worst_seconds")


register("stream_punctuality", _punctual, f"""
with {_DELIVERIES}, b as (select event_type relation, (epoch_us(ts) // 86400000000 + 1) * 86400 as ends, epoch_us(arrived_at) // 1000000 arr, mark from d, w)
select relation, ends, count(*) n, count(*) filter (where arr > ends) n_late, greatest(max(arr - ends), 0) worst_seconds from b where ends * 1000000 <= mark group by 1, 2""")


def _merged_users(t):
    out = shared_folder(t.spark, "last-events")
    rows = _deliveries(t).select("user_id", "event_id", "event_type", "value", "arrived_at", F.col("event_id").alias("seq"))
    late.in_arrivals(rows, "arrived_at", _SPANS, lambda s: s.drop("arrived_at"), merge.merge_sink(out, ["user_id"], "seq", 16))
    return merge.read_merged(t.spark, out)


register("stream_merged_users", _merged_users, f"with {_DELIVERIES} select user_id, event_id, event_type, value from x qualify row_number() over (partition by user_id order by span desc, event_id desc) = 1")

# ---------------------------------------------------------------- walks from chosen nodes

register("least_source", lambda t: graph.least_labels(_nodes(t).where("kind = 'source'").select("node", F.col("node").alias("label")), _edges(t), _nodes(t).where("node in ('n1', 'n7')").select("node")), """
select 'r' || r_regionkey node, 'r' || r_regionkey as label from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation where n_nationkey not in (1, 7) union all select 's' || s_suppkey, 'r' || n_regionkey from supplier join nation on s_nationkey = n_nationkey where n_nationkey not in (1, 7)""")
register("reached_from", lambda t: graph.reached_from(_nodes(t).where("node in ('r1', 'n3')").select("node"), _edges(t)), """
with s as (select 'n' || n_nationkey node, 1 hops from nation where n_regionkey = 1 union all select 's' || s_suppkey, case when n_nationkey = 3 then 1 else 2 end from supplier join nation on s_nationkey = n_nationkey where n_regionkey = 1 or n_nationkey = 3) select node, min(hops)::int hops from s group by 1""")

# ---------------------------------------------------------------- builds, uncertain answers, join keys, tests on columns that can be NULL


def _build(t):
    tests = t("customer").select(F.concat(F.lit("t"), "c_custkey").alias("test"), F.when(F.col("c_custkey") % 11 != 0, F.concat(F.lit("n"), "c_nationkey")).alias("attached"))
    of_tests = t("orders").select(F.concat(F.lit("t"), "o_custkey").alias("unit"), F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "O", "fail").otherwise("skipped").alias("status"), F.col("o_orderdate").alias("at"))
    of_models = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("unit"), F.when(F.col("n_nationkey") % 7 == 0, "error").otherwise("pass").alias("status"), F.lit("1997-03-01").cast("timestamp").cast(t("orders").schema["o_orderdate"].dataType).alias("at"))
    of_regions = t("region").where("r_regionkey = 2").select(F.concat(F.lit("r"), "r_regionkey").alias("unit"), F.lit("error").alias("status"), F.lit("1997-03-01").cast("timestamp").cast(t("orders").schema["o_orderdate"].dataType).alias("at"))
    return analytics.build_coverage(_nodes(t).select("node"), tests, of_tests.union(of_models).union(of_regions), _edges(t), F.lit("1996-06-01"), F.lit("1998-02-01"))


register("build_coverage", _build, f"""
with recursive {_GRAPH},
o as (select 't' || o_custkey unit, case o_orderstatus when 'F' then 'pass' when 'O' then 'fail' else 'skipped' end status, o_orderdate done from orders where o_orderdate between '1996-06-01' and '1998-02-01'
  union all select 'n' || n_nationkey, case when n_nationkey % 7 = 0 then 'error' else 'pass' end, '1997-03-01'::timestamp from nation union all select 'r2', 'error', '1997-03-01'::timestamp),
l as (select unit, status from o qualify row_number() over (partition by unit order by done desc, status) = 1),
s as (select distinct reached node from c join l on l.unit = c.node where l.status in ('fail', 'error')),
t as (select 't' || c_custkey test, case when c_custkey % 11 <> 0 then 'n' || c_nationkey end attached from customer),
x as (select t.*, coalesce(l.status in ('pass', 'warn', 'fail', 'error'), false) and (attached is null or attached not in (select node from s)) ran from t left join l on l.unit = t.test)
select (select count(*) from v) models, (select count(*) from v where node in (select node from s)) models_skipped, count(distinct attached) models_with_a_test_declared, count(distinct attached) filter (where ran) models_an_assertion_ran_on, count(*) tests_declared, count(*) filter (where ran) tests_that_ran, count(*) filter (where not ran) tests_that_did_not_run from x""")


def _uncertain(t):
    key = F.concat(F.lit("n"), F.col("o_custkey") % 25, F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("::fit::"), F.col("o_orderkey") % 5)).otherwise(""))
    decisions = t("orders").select(key.alias("decision_key"), F.col("o_orderpriority").alias("question"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 97 / 97).alias("confidence"), F.col("o_orderdate").alias("decided_at"))
    return analytics.uncertainty(decisions, _nodes(t), _edges(t)).withColumn("mean_confidence", r(F.col("mean_confidence"), 4))


register("uncertainty", _uncertain, f"""
with recursive {_GRAPH}, d as (select 'n' || (o_custkey % 25) || case when o_orderkey % 2 = 0 then '::fit::' || (o_orderkey % 5) else '' end k, o_orderpriority q, case when o_orderstatus <> 'P' then (o_orderkey % 97)::double / 97 end confidence, o_orderdate done from orders),
l as (select split_part(k, '::', 1) model, confidence from d qualify row_number() over (partition by k, q order by done desc, confidence nulls first) = 1),
a as (select model, count(*) answers, round(avg(confidence), 4) mean_confidence, count(*) filter (where confidence < 0.6) under_the_gate from l where confidence is not null group by 1)
select a.model, (select count(distinct c.reached) from c join v on v.node = c.reached where c.node = a.model and v.kind = 'mart') marts, answers, mean_confidence, under_the_gate from a semi join v on v.node = a.model""")


def _surface(t):
    keys = F.array(F.concat(F.lit("K"), F.col("l_suppkey") % 5), F.lit("ID"), F.concat(F.lit("k"), F.col("l_linenumber") % 5), F.lit("id"))
    facts = t("lineitem").select(F.year("l_shipdate").alias("run_id"), F.concat(F.lit("p"), F.col("l_partkey") % 40).alias("child"), F.when(F.col("l_quantity") > 3, keys).otherwise(F.array().cast("array<string>")).alias("joined_on"), F.col("l_linenumber").cast("long").alias("dropped"))
    return analytics.join_surface(facts, t("orders").select(F.year("o_orderdate").alias("run_id"), F.col("o_orderdate").alias("started_at")))


register("join_surface", _surface, """
with f as (select year(l_shipdate) run_id, 'p' || (l_partkey % 40) model, case when l_quantity > 3 then array_to_string(list_sort(list_distinct(['k' || (l_suppkey % 5), 'id', 'k' || (l_linenumber % 5)])), ',') end keys, l_linenumber dropped from lineitem),
l as (select year(o_orderdate) run_id from orders where year(o_orderdate) in (select run_id from f) order by o_orderdate desc limit 1)
select model, count(*) hops, count(distinct keys) distinct_keysets, sum(dropped)::bigint columns_dropped from f semi join l using (run_id) group by 1""")


def _outrun(t):
    column = lambda x: F.concat(F.lit("c"), x)
    lineage = t("part").where("p_partkey > 0").select(column(F.col("p_partkey")).alias("column"), column(F.floor(F.col("p_partkey") / 2)).alias("parent"), (F.col("p_size") % 5 != 0).alias("carried"), (F.col("p_size") % 9 == 0).alias("guarded"))
    measured = t("lineitem").where("l_partkey % 6 < 2").groupBy(column(F.col("l_partkey")).alias("column")).agg(F.count(F.when((F.col("l_discount") == 0) & (F.col("l_quantity") > 20), 1)).alias("nulls"), F.count("*").alias("n"))
    return analytics.outrun_tests(t("part").where("p_partkey % 2 = 1").select(column(F.col("p_partkey")).alias("column")), lineage, measured)


register("test_outruns_its_source", _outrun, """
with recursive m as (select 'c' || l_partkey as column_, count(*) filter (where l_discount = 0 and l_quantity > 20) nulls, count(*) n from lineitem where l_partkey % 6 < 2 group by 1),
s as (select 'c' || (p_partkey // 2) src, 'c' || p_partkey dst from part where p_partkey > 0 and p_size % 5 <> 0 and p_size % 9 <> 0 and 'c' || p_partkey not in (select column_ from m where nulls = 0)),
w as (select column_ origin, column_ reached, 0 hops from m where nulls > 0 union select w.origin, s.dst, w.hops + 1 from w join s on s.src = w.reached)
select reached "column", origin, hops, nulls, n from w join m on m.column_ = w.origin where reached in (select 'c' || p_partkey from part where p_partkey % 2 = 1) qualify row_number() over (partition by reached order by hops, origin) = 1""")

# ---------------------------------------------------------------- places on the globe, derived from keys

_LAT, _LON = "({0} * 7919 % 180000) / 1000.0 - 90", "({0} * 104729 % 360000) / 1000.0 - 180"
_placed = lambda df, key, p, k=None: df.select(key, F.expr(f"cast({_LAT.format(k or key)} as double)").alias(f"{p}_lat"), F.expr(f"cast({_LON.format(k or key)} as double)").alias(f"{p}_lon"))
_places = lambda t: (_placed(t("customer"), "c_custkey", "c"), _placed(t("supplier"), "s_suppkey", "s", "(s_suppkey * 31 + 7)"), ("c_lat", "c_lon"), ("s_lat", "s_lon"))
_PLACES = f"""c as (select c_custkey, ({_LAT.format("c_custkey")})::double c_lat, ({_LON.format("c_custkey")})::double c_lon from customer), s as (select s_suppkey, ({_LAT.format("(s_suppkey * 31 + 7)")})::double s_lat, ({_LON.format("(s_suppkey * 31 + 7)")})::double s_lon from supplier),
p as (select *, 2 * {geo.EARTH} * asin(sqrt(least(1.0, pow(sin(radians(s_lat - c_lat) / 2), 2) + cos(radians(c_lat)) * cos(radians(s_lat)) * pow(sin(radians(s_lon - c_lon) / 2), 2)))) metres from c, s)"""
register("radius_join", lambda t: geo.radius_join(*_places(t), 700_000, lambda c: F.floor(c * 10 + 0.5) / 10).select("c_custkey", "s_suppkey", "metres"), f"with {_PLACES} select c_custkey, s_suppkey, round(metres, 1) metres from p where metres <= 700000")
register("box_against_circle", lambda t: geo.box_against_circle(*_places(t), 5.0), f"with {_PLACES}, q as (select abs(s_lat - c_lat) <= 5 and abs(s_lon - c_lon) <= 5 box, metres <= radians(5.0) * {geo.EARTH} circle from p) select count(*) filter (where box) n_box, count(*) filter (where circle) n_circle, count(*) filter (where box and not circle) n_corners from q")

# ---------------------------------------------------------------- functions of our own in SQL

register("ceil_rank", lambda t: registered.ceil_rank(t("lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.9), """
with x as (select l_returnflag, l_linestatus, l_extendedprice as value, row_number() over (partition by l_returnflag, l_linestatus order by l_extendedprice) k, count(*) over (partition by l_returnflag, l_linestatus) n from lineitem)
select l_returnflag, l_linestatus, n, value from x where k = ceil(n * 0.9::double)""")
register("spaced_events", lambda t: registered.spaced(t("events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("seconds")), ["user_id"], "seconds", 7200), """
with recursive e as (select user_id, epoch_us(ts) // 1000000 s from events), k as (select user_id, min(s) s from e group by 1 union all select k.user_id, min(e.s) from k join e on e.user_id = k.user_id and e.s >= k.s + 7200 group by k.user_id, k.s)
select user_id, s as seconds from k""")

# ---------------------------------------------------------------- facts measured on the tables, and the checks that read them

_checked = lambda facts, table, names: reduce(DataFrame.union, [checks.CHECKS[n][0]({table: facts}) for n in names])


def _loads(t):
    lines = t("lineitem").join(t("orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return producers.incremental_facts([
        producers.Incremental("deliveries", _deliveries(t), "merge", ("event_id",), "ts", batch=F.to_date("arrived_at"), columns_before=("event_id", "ts", "user_id", "kind", "value", "arrived_at")),
        producers.Incremental("orders", t("orders"), "merge", (), "o_orderdate"),
        producers.Incremental("lines", lines, "delete+insert", ("l_orderkey", "l_linenumber"), "o_orderdate", True, 30 * 86400, F.trunc("l_shipdate", "month"), "l_shipdate"),
        producers.Incremental("users", _deliveries(t).groupBy("user_id", "ts").agg(F.max("arrived_at").alias("received_at")), "microbatch", ("user_id", "ts"), "ts", True, 86400, F.to_date("received_at")),
    ])


_INCREMENTAL = ("incremental_merge_without_key", "incremental_key_not_unique", "incremental_filter_without_lookback", "lookback_shorter_than_lateness", "microbatch_without_lookback", "incremental_schema_change_ignored")
register("incremental_facts", lambda t: _loads(t).drop("columns_now", "columns_before"), f"""
with {_DELIVERIES},
a as (select max(epoch_us(arrived_at) // 1000000 - epoch_us(ts) // 1000000) late, (select count(*) from (select 1 from d group by arrived_at::date, event_id having count(*) > 1)) again from d),
l as (select l_orderkey, l_linenumber, l_shipdate, o_orderdate from lineitem join orders on l_orderkey = o_orderkey),
b as (select max(epoch_us(l_shipdate) // 1000000 - epoch_us(o_orderdate) // 1000000) late, (select count(*) from (select 1 from l group by date_trunc('month', l_shipdate), l_orderkey, l_linenumber having count(*) > 1)) again from l),
u as (select user_id, ts, max(arrived_at) got from d group by 1, 2),
c as (select max(epoch_us(got) // 1000000 - epoch_us(ts) // 1000000) late from u)
select 'deliveries' node, 'merge' strategy, 'event_id' unique_key, 'ts' filter_column, false subtracts, null::bigint lookback_seconds, late max_late_seconds, again n_repeated from a
union all select 'orders', 'merge', null, 'o_orderdate', false, null, null, null union all select 'lines', 'delete+insert', 'l_orderkey,l_linenumber', 'o_orderdate', true, 2592000, late, again from b
union all select 'users', 'microbatch', 'user_id,ts', 'ts', true, 86400, late, 0 from c""")
register("incremental_checks", lambda t: _checked(_loads(t), "incrementals", _INCREMENTAL), f"""
with {_DELIVERIES},
a as (select max(epoch_us(arrived_at) // 1000000 - epoch_us(ts) // 1000000) late, (select count(*) from (select 1 from d group by arrived_at::date, event_id having count(*) > 1)) again from d),
l as (select l_orderkey, l_linenumber, l_shipdate, o_orderdate from lineitem join orders on l_orderkey = o_orderkey),
b as (select max(epoch_us(l_shipdate) // 1000000 - epoch_us(o_orderdate) // 1000000) late, (select count(*) from (select 1 from l group by date_trunc('month', l_shipdate), l_orderkey, l_linenumber having count(*) > 1)) again from l)
select 'incremental_merge_without_key' check_name, 'orders' subject, 'merge' detail union all select 'incremental_key_not_unique', 'deliveries', again::varchar from a where again > 0 union all select 'incremental_key_not_unique', 'lines', again::varchar from b where again > 0
union all select 'incremental_filter_without_lookback', 'deliveries', 'ts' from a where late > 0 union all select 'incremental_filter_without_lookback', 'orders', 'o_orderdate'
union all select 'lookback_shorter_than_lateness', 'lines', late || '>2592000' from b where late > 2592000 union all select 'incremental_schema_change_ignored', 'deliveries', 'event_type'""")


def _hops(t):
    small = t("customer").where("c_acctbal > 8500")
    return producers.hop_facts([
        producers.Hop("orders>lineitem", t("orders"), t("lineitem"), (("o_orderkey", "l_orderkey"),)),
        producers.Hop("customer>rich", t("customer"), small, (("c_custkey", "c_custkey"),), "c_mktsegment", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment"))),
        producers.Hop("supplier>nation", t("supplier"), t("nation"), (("s_nationkey", "n_nationkey"),), "s_name", F.col("s_name")),
    ]).withColumns({c: r(F.col(c), 6) for c in ("ratio", "kept", "lost_share")})


_HOPS = """h as (select 'orders>lineitem' hop, round((select count(*) from orders join lineitem on o_orderkey = l_orderkey) / (select count(*) from orders), 6) ratio, round((select count(*) from lineitem) / (select count(*) from orders), 6) kept, null::bigint lost, null::double lost_share
union all select 'customer>rich', round(count(*) filter (where c_acctbal > 8500) / count(*), 6), round(count(*) filter (where c_acctbal > 8500) / count(*), 6), count(*) filter (where c_custkey % 3 = 0), round(count(*) filter (where c_custkey % 3 = 0) / count(*), 6) from customer
union all select 'supplier>nation', round((select count(*) from supplier join nation on s_nationkey = n_nationkey) / (select count(*) from supplier), 6), round((select count(*) from nation) / (select count(*) from supplier), 6), 0, 0.0)"""
register("hop_facts", _hops, f"with {_HOPS} select hop, ratio, kept, lost, lost_share from h")
register("hop_checks", lambda t: _checked(_hops(t), "hops", ("hop_multiplies_rows", "hop_drops_most_rows", "values_lost_at_hop")).select("check_name", "subject"), f"""
with {_HOPS} select 'hop_multiplies_rows' check_name, hop subject from h where ratio > 1 union all select 'hop_drops_most_rows', hop from h where kept < 0.2 union all select 'values_lost_at_hop', hop from h where lost > 0""")

_watched = lambda t: t("nation").where("n_nationkey % 3 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("node")).union(t("region").where("r_regionkey = 4").select(F.concat(F.lit("r"), "r_regionkey")))
_WATCHED = "m as (select 'n' || n_nationkey node from nation where n_nationkey % 3 = 0 union all select 'r4')"
register("unmonitored_sources", lambda t: producers.unmonitored_sources(_nodes(t), _edges(t), _watched(t)).select("node", F.array_join("marts", ",").alias("marts"), F.array_join("via", ",").alias("via")), """
select 'r' || n_regionkey node, string_agg(distinct 's' || s_suppkey, ',' order by 's' || s_suppkey) marts, (select string_agg(distinct 'n' || m.n_nationkey, ',' order by 'n' || m.n_nationkey) from nation m where m.n_regionkey = nation.n_regionkey and m.n_nationkey % 3 <> 0) via from nation join supplier on s_nationkey = n_nationkey where n_nationkey % 3 <> 0 and n_regionkey <> 4 group by n_regionkey""")
register("reach_facts", lambda t: producers.reach_facts(_nodes(t), _edges(t), _watched(t)), f"""
with recursive {_GRAPH}, {_WATCHED} select v.node, v.kind, (select count(distinct c.reached) from c join v k on k.node = c.reached where c.node = v.node and k.kind = 'mart') marts,
v.node in (select node from m) or coalesce((select bool_or(c.node in (select node from m)) from c where c.reached = v.node), false) watched from v""")
register("volume_checks", lambda t: _checked(producers.reach_facts(_nodes(t), _edges(t), _watched(t)), "reach", ("volume_is_not_being_watched", "source_volume_not_monitored")), f"""
with recursive {_GRAPH}, {_WATCHED}, x as (select v.node, v.kind, (select count(distinct c.reached) from c join v k on k.node = c.reached where c.node = v.node and k.kind = 'mart') marts,
v.node in (select node from m) or coalesce((select bool_or(c.node in (select node from m)) from c where c.reached = v.node), false) watched from v)
select 'volume_is_not_being_watched' check_name, node subject, marts::varchar detail from x where marts >= 1 and not watched union all select 'source_volume_not_monitored', node, marts::varchar from x where kind = 'source' and marts >= 1 and not watched""")
register("row_loss_candidates", lambda t: producers.row_loss_candidates(t("lineitem").groupBy(F.concat(F.lit("o"), F.col("l_orderkey") % 50).alias("node"), F.concat(F.lit("p"), F.col("l_partkey") % 60).alias("parent")).agg(
    F.min(F.when(F.col("l_linenumber") % 3 == 0, "left").when(F.col("l_linenumber") % 3 == 1, "inner")).alias("join_kind"), F.bool_and(F.col("l_returnflag") == "R").alias("pre_aggregated"), F.bool_and(F.col("l_discount") > 0.03).alias("driving"),
    (F.first(F.col("l_orderkey") % 50) % 7 == 0).alias("filters_rows"), (F.first(F.col("l_orderkey") % 50) % 11 == 0).alias("aggregates"), F.lit(True).alias("readable"))), """
with x as (select l_orderkey % 50 k, 'o' || (l_orderkey % 50) node, 'p' || (l_partkey % 60) parent, min(case l_linenumber % 3 when 0 then 'left' when 1 then 'inner' end) kind, bool_and(l_returnflag = 'R') pre, bool_and(l_discount > 0.03) driving from lineitem group by 1, 2, 3),
d as (select *, bool_or(driving) over (partition by node) has from x) select node, parent from d where k % 7 <> 0 and k % 11 <> 0 and not pre and coalesce(kind, 'inner') = 'inner' and (driving or not has)""")
