"""Registered queries on the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog import register, table
from corvane.operators import relational as R


@register("category_sum", "select l_returnflag category, round(sum(l_extendedprice::decimal(28,6)), 2)::double total from lineitem group by 1")
def category_sum(spark, sf):
    """Prices by return flag."""
    return R.sum_by(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice")


@register("monthly_totals", "select strftime(o_orderdate, '%Y-%m') as month, round(sum(o_totalprice::decimal(28,6)), 2)::double total from orders group by 1")
def monthly_totals(spark, sf):
    """Order totals by month."""
    return R.monthly(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")


@register("named_agg", "select o_orderpriority, round(sum(o_totalprice::decimal(28,6)), 2)::double total, count(o_totalprice) n from orders group by 1")
def named_agg(spark, sf):
    """Totals and counts by priority, the largest first."""
    return R.named_agg(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")


@register("top_customers", "select c_name, round(sum(o_totalprice::decimal(28,6)), 2)::double total from orders join customer on o_custkey = c_custkey group by 1 order by 2 desc, 1 limit 10")
def top_customers(spark, sf):
    """The ten customers who spent most; ties go by name."""
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(28,6)")).alias("spent"))
    return R.top_n(per.join(table(spark, sf, "customer").select("c_custkey", "c_name"), per.o_custkey == F.col("c_custkey")), "c_name", "spent", 10)


@register("z_scores", "with s as (select avg(l_quantity) m, stddev_pop(l_quantity) s, avg(l_tax) m2, stddev_pop(l_tax) s2 from lineitem) select l_orderkey, l_linenumber, round(case when s = 0 then 0 else (l_quantity - m) / s end, 6) z_l_quantity, round(case when s2 = 0 then 0 else (l_tax - m2) / s2 end, 6) z_l_tax from lineitem, s")
def z_scores(spark, sf):
    """Quantities and taxes as deviations from the mean."""
    return R.z_scores(table(spark, sf, "lineitem"), "l_quantity", "l_tax", keys=("l_orderkey", "l_linenumber"))


@register("run_lengths", "with a as (select *, case when event_type is not distinct from lag(event_type) over w and row_number() over w > 1 then 0 else 1 end new from events window w as (partition by user_id order by event_id)), b as (select *, sum(new) over (partition by user_id order by event_id) run from a) select user_id, run::bigint run, event_type, count(*) n from b group by all")
def run_lengths(spark, sf):
    """Runs of equal event types by user."""
    return R.run_lengths(table(spark, sf, "events"), "user_id", "event_id", "event_type")


@register("rle_text", """with c as (select conv_id, turn, unnest(string_split(coalesce(text, ''), '')) ch, unnest(range(1, length(coalesce(text, '')) + 1)) i from conversations where text <> ''),
b as (select *, case when ch = lag(ch) over (partition by conv_id, turn order by i) then 0 else 1 end new from c), r as (select *, sum(new) over (partition by conv_id, turn order by i) run from b),
g as (select conv_id, turn, run, any_value(ch) || count(*) part from r group by all), a as (select conv_id, turn, string_agg(part, '' order by run) rle from g group by all)
select conv_id, turn, coalesce(rle, '') rle from conversations left join a using (conv_id, turn)""")
def rle_text(spark, sf):
    """Run-length encoding of the whole text of each conversation's turns."""
    return table(spark, sf, "conversations").select("conv_id", "turn", R.rle(F.coalesce("text", F.lit(""))).alias("rle"))


@register("log_parse", "select event_id, strftime(ts, '%Y-%m-%d') as date, strftime(ts, '%H:%M:%S') as time, upper(event_type) as level, props as message from events")
def log_parse(spark, sf):
    """Lines of a log and back to their fields."""
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.upper("event_type"), "props")
    return table(spark, sf, "events").select("event_id", R.log_fields(line).alias("f")).select("event_id", "f.*")


@register("business_days", "select o_orderkey, (select count(*) from generate_series(o_orderdate::date, o_orderdate::date + (o_orderkey % 40)::int - 1, interval 1 day) g(d) where o_orderkey % 40 > 0 and isodow(d) < 6)::bigint n_days from orders")
def business_days(spark, sf):
    """Working days from each order for a number of days after it."""
    end = F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 40).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", R.business_days(F.col("o_orderdate"), end).alias("n_days"))


@register("utc_iso", "select event_id, strftime(make_timestamp((event_id * 7919000000)::bigint), '%Y-%m-%dT%H:%M:%SZ') iso from events")
def utc_iso(spark, sf):
    """Times from seconds, fractions dropped."""
    return table(spark, sf, "events").select("event_id", R.utc_iso(F.col("event_id") * 7919 + 0.5).alias("iso"))


@register("order_status_pivot", "select o_orderpriority, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'P') as p from orders group by 1")
def order_status_pivot(spark, sf):
    """Orders by priority and status, statuses as columns."""
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in ("F", "O", "P")])


@register("nation_revenue", "select n_name, r_name, round(sum(l_extendedprice::decimal(28,6) * (1 - l_discount::decimal(28,6))), 2)::double revenue from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all")
def nation_revenue(spark, sf):
    """Revenue by the supplier's nation: aggregated by supplier before any join."""
    line = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,6)") * (1 - F.col("l_discount").cast("decimal(10,6)"))).alias("rev"))
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    both = line.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return both.groupBy("n_name", "r_name").agg(F.round(F.sum("rev"), 2).cast("double").alias("revenue"))
