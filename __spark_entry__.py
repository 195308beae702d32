"""

Each query is registered beside its statement. Both sides inject the same dirt (texts that are
no numbers, infinities, gaps, odd label spellings) by the same SQL expression, because the
given tables are clean. Floats are rounded to 6 places; a missing value is NULL.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sievewright.config import Config  # noqa: E402
from sievewright.functions.names import normalise_columns  # noqa: E402
from sievewright.operators import (  # noqa: E402
    balance,
    clean,
    labels,
    metrics,
    model,
    neighbors,
    profile,
    scale,
    select,
    split,
)
from sievewright.plans.prepare import prepare, write_prepared  # noqa: E402
from sievewright.plans.prepare import prepare_folder as run_folder  # noqa: E402
from sievewright.plans.train import train_and_evaluate  # noqa: E402
from sievewright.session import stage, staging_root  # noqa: E402
from sievewright.sources import csv, tables  # noqa: E402
from sievewright.streaming import apply as streams  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


FLOW = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# -- names, coercion, infinities ------------------------------------------------------------

MESSY = [" Flow Bytes/s", "Fwd Header Length", "Fwd Header Length", "a..b", "_x_", "Src IP", " Label"]


@query(
    "normalise_columns",
    """select l_orderkey as flow_bytes_s, l_partkey as fwd_header_length,
              l_suppkey as fwd_header_length_1, l_quantity as a_b, l_tax as x,
              l_linenumber as source_ip, l_returnflag as label from lineitem""",
)
def normalise_columns_query(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_linenumber",
        "l_returnflag",
    )
    return normalise_columns(rows.toDF(*MESSY))


DIRTY = """case when event_id % 37 = 0 then 'Infinity' when event_id % 41 = 0 then 'n/a'
    when event_id % 43 = 0 then ' -inf ' when event_id % 47 = 0 then ''
    when event_id % 53 = 0 then '1.0d' when event_id % 59 = 0 then 'NaN'
    when event_id % 61 = 0 then '1e3'
    else concat(' ', cast(user_id as string), '.5 ') end"""
DIRTY_2 = """case when event_id % 31 = 0 then '-Infinity' when event_id % 29 = 0 then '192.168.1.1'
    else cast(event_id % 1000 as string) end"""
NUMBER = "case when trim({0}) in ('1.0d') then null else try_cast(trim({0}) as double) end"
FINITE = "case when isfinite({0}) then {0} end"
DIRTY_EVENTS = f"""raw as (select event_id, {DIRTY} as a, {DIRTY_2} as b from events),
    num as (select event_id, {NUMBER.format('a')} as a, {NUMBER.format('b')} as b from raw)"""


def dirty_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.expr(DIRTY).alias("a"), F.expr(DIRTY_2).alias("b")
    )


@query(
    "coerce_numeric",
    f"with {DIRTY_EVENTS} select event_id, {FINITE.format('a')} as a, {FINITE.format('b')} as b from num",
)
def coerce_numeric(spark, sf_dir):
    rows = clean.coerce_numbers(dirty_events(spark, sf_dir), keep=["event_id"])
    return clean.handle_infinities(rows, "nan", ["a", "b"])


@query(
    "infinite_cells",
    f"""with {DIRTY_EVENTS} select cast(sum(case when isinf(a) then 1 else 0 end
        + case when isinf(b) then 1 else 0 end) as bigint) as infinite_cells from num""",
)
def infinite_cells(spark, sf_dir):
    rows = clean.coerce_numbers(dirty_events(spark, sf_dir), keep=["event_id"])
    return clean.count_infinities(rows, ["a", "b"])


CLIP_INF = """case when {0} = 'inf'::double then (select max({0}) from num where isfinite({0}))
    when {0} = '-inf'::double then (select min({0}) from num where isfinite({0}))
    when isnan({0}) then null else {0} end"""


@query(
    "inf_clip",
    f"with {DIRTY_EVENTS} select event_id, {CLIP_INF.format('a')} as a, {CLIP_INF.format('b')} as b from num",
)
def inf_clip(spark, sf_dir):
    rows = clean.coerce_numbers(dirty_events(spark, sf_dir), keep=["event_id"])
    return clean.handle_infinities(rows, "clip", ["a", "b"])


# -- duplicates, drops, outliers --------------------------------------------------------------


@query(
    "dedup_keep_first",
    """select doc_id, md5(text) as digest, lang, n_chars, source_file from (
         select doc_id, text, lang, n_chars, source as source_file,
                row_number() over (partition by text, lang, n_chars order by doc_id) as n
         from documents) where n = 1""",
)
def dedup_keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumnRenamed("source", "source_file")
    first = clean.keep_first(rows, "doc_id", ignore=["source_file"])
    return first.select("doc_id", F.md5("text").alias("digest"), "lang", "n_chars", "source_file")


@query(
    "dedup_rows",
    """select min(event_id) as event_id, user_id, event_type, bucket from (
         select event_id, user_id, event_type,
                case when value > 40 then cast(floor(value) as bigint) end as bucket from events)
       group by user_id, event_type, bucket""",
)
def dedup_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type",
        F.when(F.col("value") > 40, F.floor("value")).alias("bucket"),
    )
    return clean.keep_first(rows, "event_id")


FENCES = """(select quantile_cont({0}, 0.25) - {1} * (quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)) as lo,
    quantile_cont({0}, 0.75) + {1} * (quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)) as hi from {2})"""


@query(
    "clip_iqr",
    f"""select o_orderkey, round(least(greatest(o_totalprice, p.lo), p.hi), 6) as o_totalprice,
               case when v is null then null else round(least(greatest(v, q.lo), q.hi), 6) end as v
        from (select *, case when o_orderkey % 11 = 0 then null
                             else cast(o_custkey * o_custkey as double) end as v from orders) as d,
             {FENCES.format('o_totalprice', 0.1, 'orders')} as p,
             {FENCES.format('case when o_orderkey % 11 = 0 then null else cast(o_custkey * o_custkey as double) end', 0.1, 'orders')} as q""",
)
def clip_iqr(spark, sf_dir):
    gap = "case when o_orderkey % 11 = 0 then null else cast(o_custkey * o_custkey as double) end"
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", F.expr(gap).alias("v")
    )
    return rounded(clean.clip_outliers(rows, 0.1, ["o_totalprice", "v"]), "o_totalprice", "v")


@query(
    "clip_counts",
    f"""select 'o_totalprice' as feature, count_if(o_totalprice < lo or o_totalprice > hi) as clipped_cells
        from orders, {FENCES.format('o_totalprice', 0.1, 'orders')}
        union all
        select 'o_custkey', count_if(o_custkey < lo or o_custkey > hi)
        from orders, {FENCES.format('o_custkey', 0.1, 'orders')}""",
)
def clip_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_totalprice", "o_custkey")
    return clean.count_clipped(rows, clean.clip_bounds(rows, factor=0.1))


@query(
    "drop_columns",
    "select o_orderkey, o_orderstatus, o_totalprice, o_orderpriority from orders",
)
def drop_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return clean.drop_columns(rows, ["o_custkey", "o_orderdate", "timestamp", "flow_id"])


@query(
    "clean_dataframe",
    f"""with raw as (select event_id, user_id, event_type, {DIRTY} as a, {DIRTY_2} as b from events),
        num as (select event_id as row_id, user_id, event_type as label, {NUMBER.format('a')} as a,
                       {NUMBER.format('b')} as b from raw),
        fin as (select row_id, user_id, label, {FINITE.format('a')} as a, {FINITE.format('b')} as b from num),
        one as (select min(row_id) as row_id, label, a, b from fin group by user_id, label, a, b),
        f as (select quantile_cont(a, 0.25) as a1, quantile_cont(a, 0.75) as a3,
                     quantile_cont(b, 0.25) as b1, quantile_cont(b, 0.75) as b3 from one)
        select row_id, label,
               case when a is null then null else
                 round(least(greatest(a, a1 - 0.2 * (a3 - a1)), a3 + 0.2 * (a3 - a1)), 6) end as a,
               case when b is null then null else
                 round(least(greatest(b, b1 - 0.2 * (b3 - b1)), b3 + 0.2 * (b3 - b1)), 6) end as b
        from one, f""",
)
def clean_dataframe(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), F.col("user_id").alias(" Source IP"),
        F.col("event_type").alias(" Label"), F.expr(DIRTY).alias("A"), F.expr(DIRTY_2).alias("B "),
    )
    done = clean.clean_dataframe(
        raw, "row_id", ["source_ip", "flow_id"], do_clip_outliers=True, clip_factor=0.2
    )
    return rounded(done, "a", "b")


@query(
    "remaining_nulls",
    f"""with {DIRTY_EVENTS} select cast(sum(case when a is null or not isfinite(a) then 1 else 0 end
        + case when b is null or not isfinite(b) then 1 else 0 end) as bigint) as null_cells from num""",
)
def remaining_nulls(spark, sf_dir):
    return clean.remaining_nulls(coerce_numeric(spark, sf_dir), ["a", "b"])


# -- labels and targets ------------------------------------------------------------------------

SPELLING = """case when event_id % 23 = 0 then null
    when event_type = 'click' then case event_id % 3 when 0 then ' BENIGN ' when 1 then 'benign' else 'Benign' end
    when event_type = 'error' then case event_id % 4 when 0 then 'Web Attack – XSS'
        when 1 then 'web attack  —  Brute Force' when 2 then 'WEB ATTACK − sql injection'
        else 'Web Attack  Brute Force' end
    when event_type = 'purchase' then case event_id % 3 when 0 then 'DoS   Hulk' when 1 then 'ddos' else 'portscan' end
    when event_type = 'signup' then ' web-attack x2y dON''T '
    else 'FTP–Patator' end"""
NORM = """trim(regexp_replace(regexp_replace(lower(raw), '[\u0096–—―−]+', '-', 'g'), ' +', ' ', 'g'))"""
TITLE = """array_to_string(list_transform(regexp_extract_all(lower(trim(raw)), '[a-z]+|[^a-z]+'),
    lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '')"""


def _map_sql() -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in labels.CANONICAL_LABELS.items())
    return f"(values {rows}) as m(norm, canonical)"


@query(
    "canonical_labels",
    f"""select event_id, coalesce(canonical, {TITLE}) as label
        from (select event_id, raw, {NORM} as norm from
                (select event_id, {SPELLING} as raw from events) where raw is not null) as r
        left join {_map_sql()} on r.norm = m.norm""",
)
def canonical_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(SPELLING).alias("label"))
    return labels.normalise_labels(rows)


@query(
    "canonical_labels_joined",
    """select event_id, case event_type when 'click' then 'BENIGN' when 'error' then 'Fault'
         else upper(substr(event_type, 1, 1)) || substr(event_type, 2) end as label from events""",
)
def canonical_labels_joined(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    mapping = events.select(F.col("event_type").alias("raw")).distinct().select(
        "raw", F.expr("case raw when 'click' then 'BENIGN' when 'error' then 'Fault' end").alias("canonical")
    )
    rows = events.select("event_id", F.col("event_type").alias("label"))
    return labels.normalise_labels(rows, mapping=mapping)


@query(
    "unknown_labels",
    f"""select distinct {NORM} as label from (select {SPELLING} as raw from events) as r
        where raw is not null and {NORM} not in (select norm from {_map_sql()})""",
)
def unknown_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.expr(SPELLING).alias("label"))
    return labels.unknown_labels(rows)


@query(
    "binary_target",
    """select l_orderkey, l_linenumber, case when l_returnflag = 'N' then 0 else 1 end as label_binary
       from lineitem""",
)
def binary_target(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return labels.binary_target(rows, "l_returnflag", benign="N").drop("l_returnflag")


CODES = """(select o_orderpriority, cast(row_number() over (
    order by case when o_orderpriority = '3-MEDIUM' then 0 else 1 end, o_orderpriority) - 1 as int) as code
    from (select distinct o_orderpriority from orders))"""


@query(
    "multiclass_target",
    f"""select o_orderkey, o_orderpriority, code as label_multi
        from orders join {CODES} using (o_orderpriority)""",
)
def multiclass_target(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return labels.multiclass_target(rows, "o_orderpriority", benign="3-MEDIUM")[0]


@query("label_map", f"select o_orderpriority as label, code from {CODES}")
def label_map(spark, sf_dir):
    return labels.label_map(table(spark, sf_dir, "orders"), "o_orderpriority", "3-MEDIUM")


@query(
    "class_names",
    f"""select distinct code as class, case when o_orderpriority = '5-LOW' then 'class_' || code
          else o_orderpriority end as class_name from {CODES}""",
)
def class_names(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    coded, mapping = labels.multiclass_target(orders, "o_orderpriority", benign="3-MEDIUM")
    seen = labels.all_classes(
        coded.filter("o_orderstatus = 'F'"), coded.filter("o_orderstatus <> 'F'"), "label_multi"
    )
    known = mapping.filter(F.col("label") != "5-LOW")
    return labels.class_names(seen.withColumnRenamed("label_multi", "class"), known)


@query(
    "label_distribution",
    """select event_type as label, count(*) as count,
              round(100.0 * count(*) / (select count(*) from events), 6) as percent
       from events group by event_type
       union all select 'TOTAL', count(*), 100.0 from events""",
)
def label_distribution(spark, sf_dir):
    return rounded(labels.label_distribution(table(spark, sf_dir, "events"), "event_type"), "percent")


@query(
    "choose_target_both",
    """select event_id, case when event_type = 'click' then 0 else 1 end as label_binary,
              cast(code as int) as label_multi
       from events join (select event_type, row_number() over (
           order by case when event_type = 'click' then 0 else 1 end,
                    upper(substr(event_type, 1, 1)) || substr(event_type, 2)) - 1 as code
         from (select distinct event_type from events)) using (event_type)""",
)
def choose_target_both(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.expr("case when event_type = 'click' then 'benign' else event_type end").alias("label"),
    )
    return labels.choose_target(labels.normalise_labels(rows), "both")[0]


@query(
    "benign_only",
    "select l_orderkey, l_linenumber, l_tax from lineitem where l_returnflag = 'N' and l_linestatus = 'O'",
)
def benign_only(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn(
        "split", F.expr("case when l_linestatus = 'O' then 'train' else 'test' end")
    )
    return balance.benign_rows(rows, "l_returnflag", "N").select("l_orderkey", "l_linenumber", "l_tax")


@query(
    "binary_from_codes",
    f"""select o_orderkey, case when code > 0 then 1 else 0 end as label_multi
        from orders join {CODES} using (o_orderpriority)""",
)
def binary_from_codes(spark, sf_dir):
    return model.binary_from_codes(multiclass_target(spark, sf_dir), "label_multi").drop(
        "o_orderpriority"
    )


# -- splits ------------------------------------------------------------------------------------

QUOTAS = """cls as (select {1} as c, count(*) as n from {0} group by 1),
    tot as (select sum(n) as n, ceil(sum(n) * {2}) as t from cls),
    share as (select c, cls.n, cls.n::double / tot.n * (tot.n - tot.t) as x,
                     (tot.n - tot.t) as train from cls, tot),
    quota as (select c, n, n - (floor(x) + case when row_number() over (order by floor(x) - x, c)
                <= max(train) over () - sum(floor(x)) over () then 1 else 0 end) as test from share)"""


@query(
    "split_stratified",
    f"""with {QUOTAS.format('orders', 'o_orderpriority', 0.2)}
        select o_orderkey, o_orderpriority, case when r <= test then 'test' else 'train' end as split
        from (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority
                order by md5(concat_ws('|', o_orderkey, 42))) as r from orders) as d
        join quota on d.o_orderpriority = quota.c""",
)
def split_stratified(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return split.stratified_split(rows, "o_orderpriority", 0.2, 0.0, 42, "o_orderkey")


@query(
    "split_day",
    """with d as (select l_orderkey, l_linenumber, l_extendedprice, dayname(l_shipdate) as day from lineitem)
       select l_orderkey, l_linenumber, l_extendedprice, 'train' as split from d where day <> 'Friday'
       union all
       select l_orderkey, l_linenumber, l_extendedprice, 'test' from d where day in ('Thursday', 'Friday')""",
)
def split_day(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        F.date_format("l_shipdate", "EEEE").alias("source_file"),
    )
    days = {"train": ["MONDAY", "tuesday", "wednesday", "thursday"], "val": [],
            "test": ["friday", "Thursday"]}
    return split.split_dataset(rows, "l_returnflag", "day_based", day_assignment=days)


@query(
    "split_ordered",
    """select event_id, case when r > n - cast(floor(n * 0.2) as bigint) then 'test' else 'train' end as split
       from (select event_id, row_number() over (order by ts, event_id) as r, count(*) over () as n
             from events)""",
)
def split_ordered(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts")
    return split.ordered_split(rows, ["ts", "event_id"], 0.2).drop("ts")


@query(
    "split_ordered_val",
    """select event_id, case when r > n - cast(floor(n * 0.2) as bigint) then 'test'
                             when r > n - cast(floor(n * 0.2) as bigint) - cast(floor(n * 0.1) as bigint)
                             then 'val' else 'train' end as split
       from (select event_id, row_number() over (order by event_type, user_id, event_id) as r,
                    count(*) over () as n from events)""",
)
def split_ordered_val(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    done = split.ordered_split(rows, ["event_type", "user_id", "event_id"], 0.2, 0.1)
    return done.select("event_id", "split")


# -- imputing and scaling ------------------------------------------------------------------------

GAPPY = """select event_id, case when event_id % 5 = 0 then 'test' else 'train' end as split,
    case when event_id % 7 = 0 then null else value end as a,
    case when event_id % 3 = 0 then null else cast(user_id as double) end as b from events"""


def gappy_events(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "case when event_id % 5 = 0 then 'test' else 'train' end as split",
        "case when event_id % 7 = 0 then null else value end as a",
        "case when event_id % 3 = 0 then null else cast(user_id as double) end as b",
    )


def _impute_sql(fill: str) -> str:
    return f"""with d as ({GAPPY}), f as (select {fill.format('a')} as fa, {fill.format('b')} as fb
                 from d where split = 'train')
               select event_id, split, round(coalesce(a, fa), 6) as a, round(coalesce(b, fb), 6) as b
               from d, f"""


def _impute_query(strategy: str) -> Query:
    def run(spark, sf_dir):
        done, _ = scale.impute(gappy_events(spark, sf_dir), ["a", "b"], strategy)
        return rounded(done, "a", "b")

    return run


query("impute_median", _impute_sql("median({0})"))(_impute_query("median"))
query("impute_mean", _impute_sql("avg({0})"))(_impute_query("mean"))
query("impute_zero", _impute_sql("max(0.0::double)"))(_impute_query("zero"))
query(
    "impute_most_frequent",
    _impute_sql(
        """(select v from (select {0} as v, count(*) as n from d
             where split = 'train' and {0} is not null group by 1 order by n desc, v limit 1))"""
    ).replace("from d where split = 'train')\n               select event_id", ")\n               select event_id"),
)(_impute_query("most_frequent"))


@query("impute_drop_rows", f"select * from ({GAPPY}) where a is not null and b is not null")
def impute_drop_rows(spark, sf_dir):
    return scale.drop_incomplete(gappy_events(spark, sf_dir), ["a", "b"])


@query(
    "impute_parameters",
    f"""with d as ({GAPPY}) select 'a' as feature, median(a) as fill from d where split = 'train'
        union all select 'b', median(b) from d where split = 'train'""",
)
def impute_parameters(spark, sf_dir):
    return scale.fit_imputer(gappy_events(spark, sf_dir), ["a", "b"], "median")


SPLIT_FLOW = "case when l_linestatus = 'F' then 'test' else 'train' end"


def flow_rows(spark, sf_dir, *extra):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", *FLOW, *extra, F.expr(SPLIT_FLOW).alias("split"),
        F.lit(7.0).alias("flat"),
    )


def _scale_sql(centre: str, spread: str) -> str:
    features = [*FLOW, "flat"]
    fits = ", ".join(
        f"{centre.format(c)} as m_{c}, {spread.format(c)} as s_{c}" for c in features
    )
    shown = ", ".join(
        f"round(({c} - m_{c}) / case when s_{c} = 0 then 1 else s_{c} end, 6) + 0.0 as {c}"
        for c in features
    )
    return f"""with d as (select l_orderkey, l_linenumber, {', '.join(FLOW)}, {SPLIT_FLOW} as split,
                 7.0::double as flat from lineitem),
               f as (select {fits} from d where split = 'train')
               select l_orderkey, l_linenumber, split, {shown} from d, f"""


def _scale_query(scaler: str) -> Query:
    def run(spark, sf_dir):
        features = [*FLOW, "flat"]
        done, _ = scale.scale(flow_rows(spark, sf_dir), features, scaler)
        return rounded(done, *features)

    return run


query("scale_standard", _scale_sql("avg({0})", "stddev_pop({0})"))(_scale_query("standard"))
query(
    "scale_robust",
    _scale_sql("median({0})", "(quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25))"),
)(_scale_query("robust"))
query("scale_minmax", _scale_sql("min({0})", "(max({0}) - min({0}))"))(_scale_query("minmax"))
query("scale_none", _scale_sql("max(0)", "max(1)"))(_scale_query("none"))


# -- weights and random rebalancing ----------------------------------------------------------------


@query(
    "class_weights",
    """select o_orderpriority as class, round((select count(*) from orders)
         / (count(*) * (select count(distinct o_orderpriority) from orders)::double), 6) as weight
       from orders group by 1""",
)
def class_weights(spark, sf_dir):
    return rounded(balance.class_weights(table(spark, sf_dir, "orders"), "o_orderpriority"), "weight")


@query(
    "class_weights_custom",
    """select o_orderkey, case o_orderpriority when '1-URGENT' then 5.0 when '5-LOW' then 0.5
         else 1.0 end::double as weight from orders""",
)
def class_weights_custom(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    chosen = balance.class_weights(rows, "o_orderpriority", {"1-URGENT": 5.0, "5-LOW": 0.5})
    return balance.with_weights(rows, "o_orderpriority", chosen).drop("o_orderpriority")


DRAW = "('0x' || substr(md5(concat_ws('|', {0})), 1, 15))::bigint"


@query(
    "random_over",
    f"""with c as (select quality, count(*) as n from labels group by 1),
        num as (select doc_id, quality, toxic, row_number() over (partition by quality
                  order by md5(concat_ws('|', doc_id, 42))) - 1 as o from labels),
        draws as (select quality, n, unnest(range(0, (select max(n) from c) - n)) as draw from c)
        select cast(doc_id as varchar) as doc_id, quality, toxic from labels
        union all
        select d.quality || '#' || d.draw, d.quality, num.toxic from draws as d
        join num on num.quality = d.quality and num.o = {DRAW.format('d.quality, d.draw, 42')} % d.n""",
)
def random_over(spark, sf_dir):
    return balance.resample(
        table(spark, sf_dir, "labels"), "quality", [], "random_over", key="doc_id"
    )


@query(
    "random_under",
    """select cast(doc_id as varchar) as doc_id, quality, toxic from (select *, row_number() over (partition by toxic
         order by md5(concat_ws('|', doc_id, 42))) as r from labels)
       where r <= (select min(n) from (select count(*) as n from labels group by toxic))""",
)
def random_under(spark, sf_dir):
    return balance.resample(
        table(spark, sf_dir, "labels"), "toxic", [], "random_under", key="doc_id"
    )


# -- feature selection ---------------------------------------------------------------------------------

SELECTABLE = [*FLOW, "twice", "minus", "flat"]
SELECT_SQL = f"""(select {', '.join(FLOW)}, 2 * l_quantity as twice, -l_extendedprice as minus,
    7.0::double as flat from lineitem where {SPLIT_FLOW} = 'train')"""


def selectable(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        *FLOW, (2 * F.col("l_quantity")).alias("twice"), (-F.col("l_extendedprice")).alias("minus"),
        F.lit(7.0).alias("flat"), F.expr(SPLIT_FLOW).alias("split"),
    )


@query(
    "variance_table",
    " union all ".join(
        f"select '{c}' as feature, round(var_pop({c}), 4) as variance from {SELECT_SQL}"
        for c in SELECTABLE
    ),
)
def variance_table(spark, sf_dir):
    found = select.variance_table(selectable(spark, sf_dir), SELECTABLE)
    return found.withColumn("variance", F.round("variance", 4))


@query(
    "variance_filter",
    f"""select l_quantity, l_extendedprice, twice, minus, split from (
          select *, 2 * l_quantity as twice, -l_extendedprice as minus, {SPLIT_FLOW} as split from lineitem)""",
)
def variance_filter(spark, sf_dir):
    return select.variance_filter(selectable(spark, sf_dir), SELECTABLE, 0.01)[0]


def _pairs_sql() -> str:
    parts = []
    for i, a in enumerate(SELECTABLE):
        for j, b in enumerate(SELECTABLE):
            if i < j:
                parts.append(
                    f"""select {i} as i, {j} as j, '{a}' as feature_i, '{b}' as feature_j,
                        round(case when max({a}) > min({a}) and max({b}) > min({b}) then
                          covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) end, 6) as r
                        from {SELECT_SQL}"""
                )
    return " union all ".join(parts)


@query("correlation_matrix", _pairs_sql())
def correlation_matrix(spark, sf_dir):
    rows = scale.training_rows(selectable(spark, sf_dir))
    return rounded(select.correlation_matrix(rows, SELECTABLE), "r")


@query(
    "correlation_filter",
    f"select distinct feature_j as feature from ({_pairs_sql()}) where abs(r) > 0.95",
)
def correlation_filter(spark, sf_dir):
    return select.correlated_features(selectable(spark, sf_dir), SELECTABLE)


MI_FEATURES = ["p_size", "p_retailprice", "p_partkey"]


def _mi_sql(limit: int) -> str:
    parts = []
    for c in MI_FEATURES:
        cuts = " + ".join(
            f"case when {c} > (select quantile_cont({c}, {i / 10}) from part) then 1 else 0 end"
            for i in range(1, 10)
        )
        parts.append(f"select '{c}' as feature, p_brand as y, {cuts} as b from part")
    return f"""with cells as ({' union all '.join(parts)}),
        j as (select feature, b, y, count(*)::double as n from cells group by all),
        w as (select feature, n, sum(n) over (partition by feature) as t,
                     sum(n) over (partition by feature, b) as nb,
                     sum(n) over (partition by feature, y) as ny from j)
        select feature, round(greatest(sum(n / t * ln(n * t / (nb * ny))), 0), 6) as mi_score
        from w group by feature order by mi_score desc, feature limit {limit}"""


@query("mi_binned_topk", _mi_sql(2))
def mi_binned_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(*MI_FEATURES, "p_brand")
    return rounded(select.mutual_info_ranking(rows, MI_FEATURES, "p_brand", 2), "mi_score")


def _mi_knn_sql(features: list[str]) -> str:
    """The estimator spelled out: k-th own-class neighbour, then rows inside that distance."""
    cells = " union all ".join(
        f"select p_partkey as k, p_type as y, {c}::double as x, '{c}' as f from part" for c in features
    )
    draw = "('0x' || substr(md5(concat_ws('|', k, f, 42)), {0}, 13))::bigint / 4503599627370496::double"
    return f"""with base as ({cells}),
        st as (select f, stddev_pop(x) as s, avg(abs(x)) as m from base group by f),
        j as (select f, k, y, x / s + ({draw.format(1)} + {draw.format(14)} - 1) * 1e-10::double
                       * greatest(1, m / s) as v from base join st using (f)),
        cnt as (select f, y, count(*) as n_y from j group by 1, 2),
        nb as (select a.f, a.k, a.y, a.v, b.v as w,
                      row_number() over (partition by a.f, a.k order by abs(a.v - b.v)) as r
               from j as a join j as b on a.f = b.f and a.y = b.y and a.k <> b.k),
        iv as (select f, k, n_y, least(3, n_y - 1) as kk,
                      case when w < v then w else v - abs(w - v) end as low,
                      case when w > v then w else v + abs(w - v) end as high
               from nb join cnt using (f, y) where r = least(3, n_y - 1)),
        inside as (select iv.f, iv.k, n_y, kk, count(*) as m from iv join j
                   on iv.f = j.f and j.v > low and j.v < high group by all),
        dg as (select i + 1 as n, -0.5772156649015329::double + sum(1 / (i::double)) over (order by i) as d
               from range(1, (select count(*) from part) + 1) as t(i)
               union all select 1, -0.5772156649015329::double),
        tot as (select f, count(*) as n from inside group by f)
        select inside.f as feature, round(greatest(0, any_value(dn.d) + avg(dk.d) - avg(dy.d) - avg(dm.d)), 6) as mi_score
        from inside join tot using (f) join dg as dn on dn.n = tot.n join dg as dk on dk.n = kk
        join dg as dy on dy.n = n_y join dg as dm on dm.n = m group by inside.f"""


@query("mi_knn", _mi_knn_sql(["p_size", "p_retailprice"]))
def mi_knn(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_type")
    ranked = select.mutual_info_ranking(
        rows, ["p_size", "p_retailprice"], "p_type", method="knn", key="p_partkey"
    )
    return rounded(ranked, "mi_score")


# -- neighbours and synthetic rebalancing ----------------------------------------------------------------

VECTOR = [f"e{i}" for i in range(64)]


def embedded(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "label", *[f"cast(embedding[{i}] as double) as {c}" for i, c in enumerate(VECTOR)]
    )


RARE = "(select vec_id, embedding, cast(label = 3 as int) as label from embeddings)"


def rare(spark, sf_dir):
    """One class in ten against the rest."""
    return embedded(spark, sf_dir).withColumn("label", (F.col("label") == 3).cast("int"))


def _knn_sql(k: int, same_class: bool, source: str = "embeddings") -> str:
    extra = "and a.label = b.label" if same_class else ""
    return f"""(select vec_id, nn_id, distance, la, lb, rank from (
        select a.vec_id, b.vec_id as nn_id, a.label as la, b.label as lb,
               list_distance(a.embedding::double[], b.embedding::double[]) as distance,
               row_number() over (partition by a.vec_id order by
                 list_distance(a.embedding::double[], b.embedding::double[]), b.vec_id) as rank
        from {source} as a join {source} as b on a.vec_id <> b.vec_id {extra}) where rank <= {k})"""


@query("knn", f"select vec_id, cast(rank as int) as rank, nn_id, round(distance, 6) as distance from {_knn_sql(5, False)}")
def knn(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rounded(neighbors.nearest_neighbours(rows, rows, 5, "vec_id", "embedding"), "distance")


@query(
    "knn_within_class",
    f"select vec_id, cast(rank as int) as rank, nn_id, round(distance, 6) as distance from {_knn_sql(3, True)}",
)
def knn_within_class(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = neighbors.nearest_neighbours(rows, rows, 3, "vec_id", "embedding", "label")
    return rounded(found, "distance")


@query(
    "tomek_links",
    f"""with r as materialized (select vec_id, label, embedding::double[] as v from {RARE}),
        d as materialized (select a.vec_id, b.vec_id as nn_id, a.label <> b.label as mixed, list_distance(a.v, b.v) as distance
                           from r as a join r as b on a.vec_id <> b.vec_id),
        least as materialized (select vec_id, min(distance) as distance from d group by 1),
        n as materialized (select vec_id, min(nn_id) as nn_id, arg_min(mixed, nn_id) as mixed
                           from d join least using (vec_id, distance) group by 1)
        select a.vec_id, a.nn_id from n as a join n as b
        on a.nn_id = b.vec_id and b.nn_id = a.vec_id where a.mixed""",
)
def tomek_links(spark, sf_dir):
    return balance.tomek_links(rare(spark, sf_dir), "label", VECTOR, "vec_id")


@query(
    "enn_filter",
    f"""select vec_id, label from {RARE} where vec_id not in
        (select vec_id from {_knn_sql(3, False, RARE)} where la <> lb)""",
)
def enn_filter(spark, sf_dir):
    kept = balance.remove_disagreeing(rare(spark, sf_dir), "label", VECTOR, 3, "vec_id")
    return kept.select("vec_id", "label")


UNIT = "(('0x' || substr(md5(concat_ws('|', {0})), 16, 13))::bigint / 4503599627370496::double)"


def _smote_ctes() -> str:
    """Draws, neighbours and mixed vectors, as the operator defines them."""
    return f"""c as (select label, count(*) as n from embeddings group by 1),
        num as (select vec_id, label, embedding::double[] as v, row_number() over (partition by label
                  order by md5(concat_ws('|', vec_id, 42))) - 1 as o from embeddings),
        draws as (select label, n, unnest(range(0, (select max(n) from c) - n)) as draw from c
                  where label <> (select min(label) from c where n = (select max(n) from c))),
        slot as (select label, draw, {DRAW.format('label, draw, 42')} % (n * 5) as s,
                        {UNIT.format('label, draw, 42')} as u from draws),
        near as (select vec_id, nn_id, rank from {_knn_sql(5, True)}),
        made as (select slot.label || '#' || draw as vec_id, slot.label, u, a.v as p, b.v as q
                 from slot join num as a on a.label = slot.label and a.o = slot.s // 5
                 join near on near.vec_id = a.vec_id and near.rank = slot.s % 5 + 1
                 join num as b on b.vec_id = near.nn_id),
        grown as (select vec_id::varchar as vec_id, label, embedding::double[] as embedding from embeddings
                  union all
                  select vec_id, label, list_transform(range(1, 65), lambda i: p[i] + u * (q[i] - p[i])) from made)"""


def _shown_sql(source: str, where: str = "") -> str:
    shown = ", ".join(f"round(embedding[{i + 1}], 6) as {c}" for i, c in enumerate(VECTOR))
    return f"select vec_id, label, {shown} from {source} {where}"


def _resample_query(method: str, source: Query = embedded) -> Query:
    def run(spark, sf_dir):
        done = balance.resample(source(spark, sf_dir), "label", VECTOR, method, key="vec_id")
        return rounded(done.select("vec_id", "label", *VECTOR), *VECTOR)

    return run


query("smote", f"with {_smote_ctes()} {_shown_sql('grown')}")(_resample_query("smote"))
query(
    "smote_tomek",
    f"""with {_smote_ctes()}, k as materialized (select * from {_knn_sql(1, False, 'grown')}),
        links as (select a.vec_id from k as a join k as b on a.nn_id = b.vec_id and b.nn_id = a.vec_id
                  where a.la <> a.lb)
        {_shown_sql('grown', 'where vec_id not in (select vec_id from links)')}""",
)(_resample_query("smote_tomek"))
query(
    "smote_enn",
    f"""with {_smote_ctes()}
        {_shown_sql('grown', f"where vec_id not in (select vec_id from {_knn_sql(3, False, 'grown')} where la <> lb)")}""",
)(_resample_query("smote_enn"))
query(
    "adasyn",
    f"""with r as materialized {RARE}, c as (select label, count(*) as n from r group by 1),
        g as (select label, (select max(n) from c) - n as add from c where n < (select max(n) from c)),
        around as (select vec_id, la as label, count(*) filter (where la <> lb) as foreign_n
                   from {_knn_sql(5, False, 'r')} group by all),
        m as (select vec_id, label, cast(round_even(foreign_n::double
                  / sum(foreign_n) over (partition by label) * add, 0) as bigint) as m
              from around join g using (label)),
        draws as (select vec_id, label, unnest(range(1, m + 1)) as i from m),
        slot as (select vec_id, label, i, {DRAW.format('vec_id, i, 42')} % 5 + 1 as rank,
                        {UNIT.format('vec_id, i, 42')} as u from draws),
        near as (select vec_id, nn_id, rank from {_knn_sql(5, True, 'r')}),
        made as (select slot.label || '#' || slot.vec_id || '#' || i as vec_id, slot.label, u,
                        a.embedding::double[] as p, b.embedding::double[] as q
                 from slot join near using (vec_id, rank) join r as a using (vec_id)
                 join r as b on b.vec_id = nn_id),
        grown as (select vec_id::varchar as vec_id, label, embedding::double[] as embedding from r
                  union all
                  select vec_id, label, list_transform(range(1, 65), lambda i: p[i] + u * (q[i] - p[i])) from made)
        {_shown_sql('grown')}""",
)(_resample_query("adasyn", rare))


@query(
    "sampling_strategies",
    """with c as (select event_type as label, count(*) as n from events group by 1),
            t as (select max(n) as top, min(n) as least, min(label) filter (where n = (select max(n) from c)) as largest,
                         min(label) filter (where n = (select min(n) from c)) as smallest from c)
       select 'over minority' as way, label, case when label = smallest then top else n end as count from c, t
       union all select 'over not majority', label, case when label <> largest then top else n end from c, t
       union all select 'over dict', label, case when label = 'error' then top + 7 else n end from c, t
       union all select 'under majority', label, case when label = largest then least else n end from c, t
       union all select 'under all', label, least from c, t
       union all select 'under dict', label, case when label = 'click' then least // 2 else n end from c, t""",
)
def sampling_strategies(spark, sf_dir):
    """Class sizes after random sampling by every kind of strategy."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "event_type as label")
    sizes = [r["count"] for r in rows.groupBy("label").count().collect()]
    ways = {
        "over minority": (balance.random_over, "minority"), "over not majority": (balance.random_over, "not majority"),
        "over dict": (balance.random_over, {"error": max(sizes) + 7}), "under majority": (balance.random_under, "majority"),
        "under all": (balance.random_under, "all"), "under dict": (balance.random_under, {"click": min(sizes) // 2}),
    }
    found = None
    for way, (sample, strategy) in ways.items():
        done = sample(rows, "label", strategy, key="event_id").groupBy("label").count()
        done = done.select(F.lit(way).alias("way"), "label", "count")
        found = done if found is None else found.unionByName(done)
    return found


@query(
    "smote_tiny_class",
    """with r as (select vec_id, case when vec_id < 3 then 99 else label end as label from embeddings),
            c as (select label, count(*) as n from r group by 1)
       select label, case when label = 99 then n else (select max(n) from c) end as count from c""",
)
def smote_tiny_class(spark, sf_dir):
    """A class of three rows is left alone and lowers the number of neighbours for all."""
    rows = embedded(spark, sf_dir).withColumn("label", F.when(F.col("vec_id") < 3, 99).otherwise(F.col("label")))
    return balance.resample(rows, "label", VECTOR, "smote", key="vec_id").groupBy("label").count()


# -- metrics -----------------------------------------------------------------------------------------

JUDGED = """select o_orderkey, cast(substr(o_orderpriority, 1, 1) as int) - 1 as y,
    cast(case when o_custkey % 3 = 0 then o_orderkey % 4 else substr(o_orderpriority, 1, 1)::int - 1 end as int)
    as prediction from orders"""


def judged(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "cast(substr(o_orderpriority, 1, 1) as int) - 1 as y",
        """cast(case when o_custkey % 3 = 0 then o_orderkey % 4
             else cast(substr(o_orderpriority, 1, 1) as int) - 1 end as int) as prediction""",
    )


def judged_binary(spark, sf_dir):
    return judged(spark, sf_dir).selectExpr(
        "cast(y > 1 as int) as y", "cast(prediction > 1 as int) as prediction"
    )


CONFUSION = f"""(select a.l as actual, p.l as predicted, count(d.y) as count
    from (select unnest(range(0, 5)) as l) as a, (select unnest(range(0, 5)) as l) as p
    left join ({JUDGED}) as d on d.y = a.l and d.prediction = p.l group by all)"""
PER_CLASS = f"""(select k.l as class, sum(case when actual = k.l and predicted = k.l then count else 0 end)::double as hits,
    sum(case when predicted = k.l then count else 0 end)::double as said,
    sum(case when actual = k.l then count else 0 end)::double as support
    from {CONFUSION} as t, (select unnest(range(0, 5)) as l) as k group by 1)"""
SCORED_CLASS = f"""(select *, case when said = 0 then 0 else hits / said end as precision,
    case when support = 0 then 0 else hits / support end as recall,
    case when said + support = 0 then 0 else 2 * hits / (said + support) end as f1 from {PER_CLASS})"""


@query("confusion", f"select cast(actual as int) as actual, cast(predicted as int) as predicted, count from {CONFUSION}")
def confusion(spark, sf_dir):
    return metrics.confusion_table(judged(spark, sf_dir), labels=[0, 1, 2, 3, 4])


@query(
    "class_report",
    f"""with s as (select * from {SCORED_CLASS})
        select cast(class as varchar) as class, round(precision, 6) as precision, round(recall, 6) as recall,
               round(f1, 6) as f1, cast(support as bigint) as support from s
        union all select 'accuracy', round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6),
               round(sum(hits) / sum(support), 6), sum(support)::bigint from s
        union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
               sum(support)::bigint from s
        union all select 'weighted avg', round(sum(precision * support) / sum(support), 6),
               round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
               sum(support)::bigint from s""",
)
def class_report(spark, sf_dir):
    return rounded(metrics.class_report(judged(spark, sf_dir)), "precision", "recall", "f1")


@query(
    "core_metrics",
    f"""with d as (select case when y > 1 then 1 else 0 end as y, case when prediction > 1 then 1 else 0 end as p
                   from ({JUDGED})),
        m as (select count_if(y = 1 and p = 1)::double as tp, count_if(y = 0 and p = 1)::double as fp,
                     count_if(y = 1 and p = 0)::double as fn, count_if(y = 0 and p = 0)::double as tn from d),
        r as (select (tp + tn) / (tp + fp + fn + tn) as accuracy,
                     (tp / (tp + fn) + tn / (tn + fp)) / 2 as balanced_accuracy, tp, fp, fn, tn,
                     fp / (fp + tn) as fpr, tp / (tp + fp) as precision, tp / (tp + fn) as recall,
                     2 * tp / (2 * tp + fp + fn) as f1 from m)
        select metric, round(value, 6) as value from (unpivot r on columns(*) into name metric value value)""",
)
def core_metrics(spark, sf_dir):
    return rounded(metrics.core_metrics(judged_binary(spark, sf_dir)), "value")


@query(
    "core_metrics_multiclass",
    f"""with s as (select * from {SCORED_CLASS}),
        r as (select sum(hits) / sum(support) as accuracy,
                     avg(recall) filter (where support > 0) as balanced_accuracy,
                     sum(precision * support) / sum(support) as precision_weighted,
                     sum(recall * support) / sum(support) as recall_weighted,
                     sum(f1 * support) / sum(support) as f1_weighted from s)
        select metric, round(value, 6) as value from (unpivot r on columns(*) into name metric value value)""",
)
def core_metrics_multiclass(spark, sf_dir):
    return rounded(metrics.core_metrics(judged(spark, sf_dir), task="multiclass"), "value")


SCORES = """select case when event_type in ('error', 'purchase') then 1 else 0 end as y,
    floor(value) / (floor(value) + case when event_type = 'error' then 20 else 40 end) as p from events"""


def scored(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "cast(event_type in ('error', 'purchase') as int) as y",
        """cast(floor(value) as double) / (floor(value) + case when event_type = 'error' then 20 else 40 end)
           as p""",
    )


CURVE = f"""t as (select p, sum(y) as pos, sum(1 - y) as neg from ({SCORES}) group by p),
    r as (select p, pos, neg, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over () as tot_p,
                 sum(neg) over () as tot_n from t window w as (order by p desc))"""


@query(
    "probability_metrics",
    f"""with {CURVE}, q as (select *, tp / (tp + fp) as prec,
            case when tp + fp = pos + neg then 1.0 else (tp - pos) / (tp + fp - pos - neg) end as before from r),
        v as (select (sum(neg * (tp - pos / 2)) / max(tot_p * tot_n))::double as roc_auc,
                     (sum(pos * (prec + before) / 2) / max(tot_p))::double as pr_auc,
                     (sum(pos * prec) / max(tot_p))::double as average_precision from q)
        select metric, round(value, 6) as value from (unpivot v on columns(*) into name metric value value)""",
)
def probability_metrics(spark, sf_dir):
    return rounded(metrics.probability_metrics(scored(spark, sf_dir)), "value")


@query(
    "roc_points",
    f"""with {CURVE}, e as (select *, lead(pos) over (order by p desc) as np, lead(neg) over (order by p desc) as nn,
              row_number() over (order by p desc) as i from r)
        select round(p, 6) as threshold, round((fp / tot_n)::double, 6) as fpr, round((tp / tot_p)::double, 6) as tpr
        from e where i = 1 or np is null or np <> pos or nn <> neg
        union all select 'inf'::double, 0, 0""",
)
def roc_points(spark, sf_dir):
    return rounded(metrics.roc_points(scored(spark, sf_dir)), "fpr", "tpr").withColumn(
        "threshold",
        F.when(F.col("threshold") < float("inf"), F.round("threshold", 6)).otherwise(F.col("threshold")),
    )


@query(
    "pr_points",
    f"""with {CURVE} select round(p, 6) as threshold, round((tp / tot_p)::double, 6) as recall,
          round((tp / (tp + fp))::double, 6) as precision,
          round((tot_p / (tot_p + tot_n))::double, 6) as baseline from r
        union all select null, 0, 1, round((max(tot_p) / max(tot_p + tot_n))::double, 6) from r""",
)
def pr_points(spark, sf_dir):
    return rounded(
        metrics.pr_points(scored(spark, sf_dir)), "threshold", "recall", "precision", "baseline"
    )


OVR = """select case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 else 3 end as y,
    floor(value) / 1000.0 as p0, (event_id % 100) / 100.0 as p1,
    (user_id % 17) / (17.0 + case when event_type = 'purchase' then 3 else 9 end) as p2, 0.5 as p3 from events"""


@query(
    "auc_ovr",
    f"""with d as ({OVR}), s as (
          {' union all '.join(f"select {c} as class, case when y = {c} then 1 else 0 end as y, p{c}::double as p from d" for c in range(4))}),
        t as (select class, p, sum(y) as pos, sum(1 - y) as neg from s group by class, p),
        r as (select *, sum(pos) over (partition by class order by p desc) as tp from t),
        a as (select class, sum(pos) as support, sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) as auc
              from r group by class having sum(pos) > 0 and sum(neg) > 0)
        select cast(class as int) as class, cast(support as bigint) as support, round(auc::double, 6) as roc_auc from a""",
)
def auc_ovr(spark, sf_dir):
    return rounded(metrics.one_vs_rest_auc(_ovr(spark, sf_dir), [0, 1, 2, 3]), "roc_auc")


def _ovr(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 else 3 end as y",
        """array(floor(value) / 1000D, (event_id % 100) / 100D,
             (user_id % 17) / (17D + case when event_type = 'purchase' then 3 else 9 end), 0.5D) as probabilities""",
        "cast(user_id % 4 as int) as prediction",
    )


@query(
    "auc_ovr_weighted",
    ORACLES["auc_ovr"].replace(
        "select cast(class as int) as class, cast(support as bigint) as support, round(auc::double, 6) as roc_auc from a",
        "select 'roc_auc_ovr_weighted' as metric, round((sum(auc * support) / sum(support))::double, 6) as value from a",
    ),
)
def auc_ovr_weighted(spark, sf_dir):
    return rounded(metrics.multiclass_auc(_ovr(spark, sf_dir), [0, 1, 2, 3]), "value")


GRID = ", ".join(f"({t!r}::double)" for t in metrics.THRESHOLDS)
SWEEP = f"""(select t as threshold, count_if(y = 1 and p >= t)::double as tp, count_if(y = 0 and p >= t)::double as fp,
      count_if(y = 1 and p < t)::double as fn, count_if(y = 0 and p < t)::double as tn
    from ({SCORES}) as d, (values {GRID}) as g(t) group by t)"""
RATES = f"""(select threshold, case when tp = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end as f1,
      case when tp + fp = 0 then 0 else tp / (tp + fp) end as precision, tp / (tp + fn) as recall,
      fp / (fp + tn) as fpr, tp, fp, fn, tn from {SWEEP})"""
SWEEP_SHOWN = """select threshold, round(f1, 6) as f1, round(precision, 6) as precision, round(recall, 6) as recall,
      round(fpr, 6) as fpr, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn from """


@query("threshold_table", f"{SWEEP_SHOWN} {RATES}")
def threshold_table(spark, sf_dir):
    return rounded(metrics.threshold_table(scored(spark, sf_dir)), "f1", "precision", "recall", "fpr")


@query("threshold_sweep", f"{SWEEP_SHOWN} (select * from {RATES} order by round(f1, 12) desc, threshold limit 1)")
def threshold_sweep(spark, sf_dir):
    return rounded(metrics.best_threshold(scored(spark, sf_dir)), "f1", "precision", "recall", "fpr")


@query(
    "apply_threshold",
    f"select y, round(p, 6) as p, case when p >= 0.37 then 1 else 0 end as prediction from ({SCORES})",
)
def apply_threshold(spark, sf_dir):
    return rounded(metrics.apply_threshold(scored(spark, sf_dir), 0.37), "p")


def _evaluation_sql(judged_sql: str, labels: list[int], overall: str) -> str:
    """Overall metrics (a statement over d) and the report of every class and average."""
    return f"""with d as materialized ({judged_sql}),
        per as (select l as class, count_if(y = l and prediction = l)::double as hits,
                       count_if(prediction = l)::double as said, count_if(y = l)::double as support
                from d, (select unnest({labels}) as l) group by l),
        s as (select *, case when said = 0 then 0 else hits / said end as precision,
                     case when support = 0 then 0 else hits / support end as recall,
                     case when said + support = 0 then 0 else 2 * hits / (said + support) end as f1 from per),
        rep as (select class::varchar as class, precision, recall, f1, support from s
            union all select 'accuracy', a, a, a, n from (select sum(hits) / sum(support) as a, sum(support) as n from s)
            union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from s
            union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support) from s)
        select 'rule' as model, metric, class, round(value, 6) as value
        from (unpivot rep on precision, recall, f1, support into name metric value value)
        union all select 'rule', metric, null, round(value, 6) from ({overall})"""


@query(
    "evaluate_binary",
    _evaluation_sql(
        f"select y, case when p >= 0.37 then 1 else 0 end as prediction from ({SCORES})", [0, 1],
        f"""with m as (select count_if(y = 1 and prediction = 1)::double as tp, count_if(y = 0 and prediction = 1)::double as fp,
                     count_if(y = 1 and prediction = 0)::double as fn, count_if(y = 0 and prediction = 0)::double as tn from d),
            r as (select (tp + tn) / (tp + fp + fn + tn) as accuracy, (tp / (tp + fn) + tn / (tn + fp)) / 2 as balanced_accuracy,
                     tp, fp, fn, tn, fp / (fp + tn) as fpr, tp / (tp + fp) as precision, tp / (tp + fn) as recall,
                     2 * tp / (2 * tp + fp + fn) as f1 from m)
            select metric, value from (unpivot r on columns(*) into name metric value value)
            union all select * from ({ORACLES['probability_metrics']})""",
    ),
)
def evaluate_binary(spark, sf_dir):
    decided = metrics.apply_threshold(scored(spark, sf_dir), 0.37)
    return rounded(metrics.evaluate(decided, "rule"), "value")


@query(
    "evaluate_multiclass",
    _evaluation_sql(
        OVR.replace(" from events", ", cast(user_id % 4 as int) as prediction from events"), [0, 1, 2, 3],
        f"""with o as (select sum(hits) / sum(support) as accuracy, avg(recall) filter (where support > 0) as balanced_accuracy,
                     sum(precision * support) / sum(support) as precision_weighted,
                     sum(recall * support) / sum(support) as recall_weighted,
                     sum(f1 * support) / sum(support) as f1_weighted from s)
            select metric, value from (unpivot o on columns(*) into name metric value value)
            union all select * from ({ORACLES['auc_ovr_weighted']})""",
    ),
)
def evaluate_multiclass(spark, sf_dir):
    found = metrics.evaluate(_ovr(spark, sf_dir), "rule", "multiclass", score="probabilities", labels=[0, 1, 2, 3])
    return rounded(found, "value")


# -- profile --------------------------------------------------------------------------------------------


@query("class_counts", "select o_orderpriority as class, count(*) as count from orders group by 1")
def class_counts(spark, sf_dir):
    return profile.class_counts_table(table(spark, sf_dir, "orders"), "o_orderpriority")


@query(
    "missing_values",
    f"""with d as ({GAPPY}) select 'event_id' as feature, 0::bigint as missing
        union all select 'a', count(*) - count(a) from d union all select 'b', count(*) - count(b) from d
        union all select 'TOTAL', 2 * count(*) - count(a) - count(b) from d""",
)
def missing_values(spark, sf_dir):
    return profile.missing_values(gappy_events(spark, sf_dir), ["event_id", "a", "b"])


def _histogram_sql() -> str:
    parts = []
    for c in ["l_quantity", "l_extendedprice"]:
        parts.append(
            f"""select '{c}' as feature, least(floor(({c} - lo) / w), 49)::int as bin, lo, w, count(*) as count
                from lineitem, (select min({c}) as lo, (max({c}) - min({c})) / 50 as w from lineitem) group by all"""
        )
    return f"""select feature, bin, round(lo + bin * w, 6) as low, round(lo + (bin + 1) * w, 6) as high, count
               from ({' union all '.join(parts)})"""


@query("histogram", _histogram_sql())
def histogram(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rounded(profile.histogram(rows, ["l_quantity", "l_extendedprice"]), "low", "high")


@query(
    "leakage_columns",
    """select 'Src_IP' as "column", count(*) - count(user_id) as missing from events
       union all select 'timestamp', count(*) - count(ts) from events""",
)
def leakage_columns(spark, sf_dir):
    """Identity columns that survived, with how many of their values are missing."""
    rows = table(spark, sf_dir, "events").selectExpr("user_id as Src_IP", "ts as timestamp", "value")
    missing = profile.missing_values(rows).withColumnRenamed("feature", "column")
    return profile.leakage_columns(rows).join(missing, "column", "left")


@query(
    "sample_rows",
    "select event_id, value from events order by md5(concat_ws('|', event_id, 42)) limit 500",
)
def sample_rows(spark, sf_dir):
    return profile.sample_rows(table(spark, sf_dir, "events").select("event_id", "value"), 500, "event_id")


# -- sources and sinks ------------------------------------------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@query(
    "ingest_csv",
    f"""with raw as (select event_id, event_type, {DIRTY} as a from events)
        select cast(event_id as varchar) as flow_id, event_type as label,
               nullif(nullif(nullif(a, 'n/a'), 'NaN'), '') as a from raw""",
)
def ingest_csv(spark, sf_dir):
    """Write the events as delimited text, then read the folder back."""
    folder = _scratch(spark, "csv")
    table(spark, sf_dir, "events").select(
        F.col("event_id").alias("Flow ID"), F.col("event_type").alias(" Label"),
        F.expr(DIRTY).alias("A"),
    ).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(folder)
    return csv.read_folder(spark, folder).select("flow_id", "label", "a")


@query(
    "ingest_statistics",
    """select event_type as source_file, count(*) as rows, 3 as columns from events group by 1
       union all select 'TOTAL', count(*), 3 from events""",
)
def ingest_statistics(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), "user_id", "value", F.col("event_type").alias("source_file")
    )
    return csv.ingest_statistics(rows)


def _sink_query(fmt: str) -> Query:
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
        path = _scratch(spark, "sink")
        tables.save(rows, path, fmt)
        back = tables.load(spark, path, fmt)
        return back.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema.fields])

    return run


for _fmt in ("parquet", "feather", "csv"):
    query(f"sink_{_fmt}", "select o_orderkey, o_custkey, o_orderstatus from orders")(_sink_query(_fmt))


ORDER_SPLIT = "case when o_orderkey % 10 = 0 then 'test' when o_orderkey % 10 = 1 then 'val' else 'train' end"


@query(
    "split_tables",
    f"""select {ORDER_SPLIT} as split, o_orderkey as row_id, o_totalprice, o_custkey,
               case when o_orderstatus = 'F' then 1 else 0 end as label_binary from orders""",
)
def split_tables(spark, sf_dir):
    """Features and targets of all splits written apart and joined again on their key."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as row_id", "o_totalprice", "o_custkey", "cast(o_orderstatus = 'F' as int) as label_binary",
        f"{ORDER_SPLIT} as split",
    )
    folder, back = _scratch(spark, "tables"), []
    for name in ("train", "val", "test"):
        tables.save_split(rows, folder, name, ["label_binary"], ["o_totalprice", "o_custkey"])
        back.append(tables.load_split(spark, folder, name).withColumn("split", F.lit(name)))
    return back[0].unionByName(back[1]).unionByName(back[2])


def _as_files(spark, written: str, folder: str, names) -> None:
    """Move the part files of a written folder into ``folder`` under a list of names, or names by number, in their order."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    files = path(written).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path(folder))
    parts = sorted(s.getPath().toString() for s in files.listStatus(path(written)) if s.getPath().getName().startswith("part-"))
    names = [names(i) for i in range(len(parts))] if callable(names) else names
    for part, name in zip(parts, names, strict=True):
        files.rename(path(part), path(f"{folder}/{name}"))


MESSY_LINE = """case when doc_id % 50 = 7 then concat(doc_id, ',x,', lang, ',surplus') when doc_id % 50 = 8 then concat('\n', doc_id)
    else concat(doc_id, ',"', replace(text, '"', '""'), '",', lang) end"""
MESSY_HEADER = "id,text, Lang"
#: More than a split of Spark's default size, so that parts are read in splits.
MESSY_PART = 160_000_000


@query(
    "ingest_messy_csv",
    """with d as (select *, (doc_id % 3) * 1099511627776 + row_number() over (partition by doc_id % 3 order by doc_id) - 1
                as row_id from documents)
       select row_id, 'file' || (doc_id % 3) as source_file, doc_id::varchar as id,
              case when doc_id % 3 <> 0 or doc_id % 50 <> 8 then text end as text,
              case when doc_id % 3 <> 0 or doc_id % 50 <> 8 then lang end as lang,
              case when doc_id % 3 = 1 then source end as note
       from d where doc_id % 3 <> 0 or doc_id % 50 <> 7""",
)
def ingest_messy_csv(spark, sf_dir):
    """Files of three kinds, some larger than a split: quotes, line breaks, blank, short and surplus lines; another header; single-byte text.

    Each is written by range of the key, in parts of `MESSY_PART` bytes of text up to twice that, or in one where it has less.
    """
    docs, folder = table(spark, sf_dir, "documents"), _scratch(spark, "messy")
    sizes = docs.groupBy((F.col("doc_id") % 3).alias("kind")).agg(F.sum(F.octet_length("text")).alias("bytes")).collect()
    parts = {r["kind"]: max(1, (r["bytes"] or 0) // MESSY_PART) for r in sizes}
    plain = docs.filter("doc_id % 3 = 0").selectExpr("doc_id", f"{MESSY_LINE} as line")
    header = spark.range(1).selectExpr("cast(null as bigint) as doc_id", f"'{MESSY_HEADER}' as line")  # sorts first
    opens = (F.monotonically_increasing_id() % (1 << 33) == 0) & F.col("doc_id").isNotNull()  # the first row of a part
    kinds = [
        (plain.unionByName(header), "doc_id"),
        (docs.filter("doc_id % 3 = 1").selectExpr("source as Note", "lang as Lang", "doc_id as ID", "text as Text"), "ID"),
        (docs.filter("doc_id % 3 = 2").selectExpr("doc_id as id", "text", "lang"), "id"),
    ]
    kinds = [rows.repartitionByRange(parts.get(i, 1), key).sortWithinPartitions(key) for i, (rows, key) in enumerate(kinds)]
    lines = kinds[0].select(F.when(opens, F.concat(F.lit(f"{MESSY_HEADER}\n"), "line")).otherwise(F.col("line")).alias("line"))
    ways = [
        lines.write.format("text"), kinds[1].write.format("csv").options(header=True, escape='"'),
        kinds[2].write.format("csv").options(header=True, escape='"', encoding="ISO-8859-1"),
    ]
    for i, way in enumerate(ways):
        way.save(f"{folder}/file{i}.csv")
    return csv.read_folder(spark, folder, parts=True).select("row_id", "source_file", "id", "text", "lang", "note")


# -- streaming ------------------------------------------------------------------------------------------------


@query("stream_clean", ORACLES["coerce_numeric"])
def stream_clean(spark, sf_dir):
    """Coerce a stream of event files micro-batch by micro-batch."""
    source = table(spark, sf_dir, "events")
    stream = (
        spark.readStream.schema(source.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
        .select("event_id", F.expr(DIRTY).alias("a"), F.expr(DIRTY_2).alias("b"))
    )
    cleaned = streams.clean_stream(stream, label_column=None, keep=("event_id",))
    folder = _scratch(spark, "stream")
    streams.write_batches(cleaned, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out").select(
        "event_id", "a", "b"
    )


def _through_stream(spark, sf_dir, change, *columns: str):
    """The events as a stream, changed and written batch by batch, then read."""
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    folder = _scratch(spark, "stream")
    streams.write_batches(change(stream), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out").select(*columns)


@query(
    "stream_prepare",
    f"""with d as ({GAPPY}), f as (select median(a) as fa, median(b) as fb from d where split = 'train'),
        i as (select event_id, split, coalesce(a, fa) as a, coalesce(b, fb) as b from d, f),
        s as (select avg(a) as ma, stddev_pop(a) as sa, avg(b) as mb, stddev_pop(b) as sb from i where split = 'train')
        select event_id, round((a - ma) / sa, 6) + 0.0 as a, round((b - mb) / sb, 6) + 0.0 as b from i, s""",
)
def stream_prepare(spark, sf_dir):
    """Impute and scale a stream by parameters fitted on batch rows."""
    rows = gappy_events(spark, sf_dir)
    filled, imputer = scale.impute(rows, ["a", "b"], "median")
    scaler = scale.fit_scaler(filled, ["a", "b"], "standard")

    def change(stream):
        gappy = stream.selectExpr(
            "event_id", "case when event_id % 7 = 0 then null else value end as a",
            "case when event_id % 3 = 0 then null else cast(user_id as double) end as b",
        )
        return streams.prepare_stream(gappy, imputer, scaler)

    return rounded(_through_stream(spark, sf_dir, change, "event_id", "a", "b"), "a", "b")


@query("stream_deduplicate", "select distinct user_id, event_type from events")
def stream_deduplicate(spark, sf_dir):
    """The first arrival of every user and type within a watermark that spans the table."""

    def change(stream):
        return streams.drop_repeats(stream, "ts", ["user_id", "event_type"], "20000 days")

    return _through_stream(spark, sf_dir, change, "user_id", "event_type")


# -- models and whole runs ----------------------------------------------------------------------------------------


def modelling_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as row_id", "o_totalprice as a", "cast(o_custkey as double) as b",
        "cast(month(o_orderdate) as double) as c",
        "cast(o_totalprice + 400 * o_custkey > 400000 as int) as y",
    )
    return split.stratified_split(rows, "y", 0.2)


def _newton_sql(frame: str) -> str:
    """Ridge logistic regression by Newton steps: standardise, weigh, 4 x 4 elimination in every step of ``it``."""
    x = ["1.0::double", "a", "b", "c"]
    grads = ", ".join(f"sum(w * (p - y) * {v}){f' + any_value(t{i})' if i else ''} as g{i}" for i, v in enumerate(x))
    hess = ", ".join(
        f"sum(w * p * (1 - p) * {x[i]} * {x[j]}){' + 1' if i == j and i else ''} as h{i}{j}"
        for i in range(4) for j in range(i, 4)
    )
    return f"""z as materialized (select row_id, y, split, (x1 - m1) / s1 as a, (x2 - m2) / s2 as b, (x3 - m3) / s3 as c
            from {frame}, (select avg(x1) as m1, stddev_pop(x1) as s1, avg(x2) as m2, stddev_pop(x2) as s2,
                                  avg(x3) as m3, stddev_pop(x3) as s3 from {frame} where split = 'train')),
        tr as materialized (select a, b, c, y::double as y, n / (2.0::double * count(*) over (partition by y)) as w
            from z, (select count(*)::double as n from z where split = 'train') where split = 'train'),
        it as (select 0 as i, 0.0::double as t0, 0.0::double as t1, 0.0::double as t2, 0.0::double as t3
          union all
          select i + 1, t0 - d0, t1 - d1, t2 - d2, t3 - d3 from (
            select *, h01 / h00 as l1, h02 / h00 as l2, h03 / h00 as l3,
              h11 - l1 * h01 as b11, h12 - l1 * h02 as b12, h13 - l1 * h03 as b13, g1 - l1 * g0 as r1,
              h22 - l2 * h02 as b22, h23 - l2 * h03 as b23, g2 - l2 * g0 as r2, h33 - l3 * h03 as b33, g3 - l3 * g0 as r3,
              b12 / b11 as k2, b13 / b11 as k3, b22 - k2 * b12 as c22, b23 - k2 * b13 as c23, r2 - k2 * r1 as q2,
              b33 - k3 * b13 as c33, r3 - k3 * r1 as q3, (q3 - c23 / c22 * q2) / (c33 - c23 / c22 * c23) as d3,
              (q2 - c23 * d3) / c22 as d2, (r1 - b12 * d2 - b13 * d3) / b11 as d1,
              (g0 - h01 * d1 - h02 * d2 - h03 * d3) / h00 as d0
            from (select i, any_value(t0) as t0, any_value(t1) as t1, any_value(t2) as t2, any_value(t3) as t3, {grads}, {hess}
              from (select it.*, a, b, c, y, w, 1 / (1 + exp(-(t0 + t1 * a + t2 * b + t3 * c))) as p from it, tr where i < 40)
              group by i))),
        fit as (select * from it where i = 40)"""


MODEL_ROWS = f"""m as (select o_orderkey as row_id, o_totalprice::double as x1, o_custkey::double as x2,
        month(o_orderdate)::double as x3, case when o_totalprice + 400 * o_custkey > 400000 then 1 else 0 end as y from orders),
    {QUOTAS.format('m', 'y', 0.2)},
    d as (select row_id, x1, x2, x3, y, case when r <= test then 'test' else 'train' end as split
          from (select *, row_number() over (partition by y order by md5(concat_ws('|', row_id, 42))) as r from m) as m
          join quota on m.y = quota.c)"""


@query(
    "lr_fit_score",
    f"""with recursive {MODEL_ROWS}, {_newton_sql('d')}
        select row_id, y, round(p, 4) as p, case when p > 0.5 then 1 else 0 end as prediction
        from (select row_id, y, 1 / (1 + exp(-(t0 + t1 * a + t2 * b + t3 * c))) as p from z, fit where split = 'test')""",
)
def lr_fit_score(spark, sf_dir):
    rows = stage(modelling_rows(spark, sf_dir), "model-rows")
    rows, _ = scale.scale(rows, ["a", "b", "c"], "standard")
    fitted = model.train_logistic_regression(rows.filter("split = 'train'"), ["a", "b", "c"], "y", tol=1e-13)
    test = model.score(rows.filter("split = 'test'"), fitted)
    return test.select("row_id", "y", F.round("p", 4).alias("p"), "prediction")


@query(
    "stream_score",
    f"""with recursive {MODEL_ROWS}, {_newton_sql('d')}
        select y as actual, case when p >= 0.5 then 1 else 0 end as prediction, least(floor(p * 10), 9)::integer as bin,
               count(*) as rows
        from (select y, 1 / (1 + exp(-(t0 + t1 * a + t2 * b + t3 * c))) as p from z, fit where split = 'test') group by 1, 2, 3""",
)
def stream_score(spark, sf_dir):
    """Test rows scored as a stream of several batches; confusion and score counts kept as state."""
    rows = stage(modelling_rows(spark, sf_dir), "model-rows")
    rows, _ = scale.scale(rows, ["a", "b", "c"], "standard")
    fitted = model.train_logistic_regression(rows.filter("split = 'train'"), ["a", "b", "c"], "y", tol=1e-13)
    test, folder = rows.filter("split = 'test'"), _scratch(spark, "scored")
    test.repartition(3).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(test.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    counts = streams.count_scores(streams.score_stream(stream, fitted), "y")
    streams.write_counts(counts, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return streams.latest_counts(spark, f"{folder}/out")


@query("lr_tuned_metrics")
def lr_tuned_metrics(spark, sf_dir):
    rows = stage(modelling_rows(spark, sf_dir), "model-rows")
    rows, _ = scale.scale(rows, ["a", "b", "c"], "standard")
    _, found = train_and_evaluate(
        rows.filter("split = 'train'"), rows.filter("split = 'test'"), ["a", "b", "c"], "y", tune=True
    )
    return rounded(found, "value")


@query("lr_multiclass_metrics")
def lr_multiclass_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as row_id", "o_totalprice as a", "cast(o_custkey as double) as b",
        "cast(floor(o_totalprice / 150000) as int) as y",
    )
    rows = stage(split.stratified_split(rows, "y", 0.2), "model-rows")
    rows, _ = scale.scale(rows, ["a", "b"], "standard")
    _, found = train_and_evaluate(
        rows.filter("split = 'train'"), rows.filter("split = 'test'"), ["a", "b"], "y", "multiclass"
    )
    return rounded(found, "value")


def raw_flows(spark, sf_dir):
    """Order lines dressed as raw flow records: texts, infinities, gaps, copies, odd labels."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 100000000 + l_partkey * 10 + l_linenumber as row_id",
        "date_format(l_shipdate, 'EEEE') as source_file",
        "case when l_partkey % 19 = 0 then 'Infinity' else cast(cast(l_quantity as bigint) as string) end as ` Quantity/s`",
        "case when l_partkey % 23 = 0 then 'n/a' else cast(cast(l_extendedprice as bigint) as string) end as `Price`",
        "cast(l_linenumber as string) as `Line`",
        "case when l_returnflag = 'N' then ' benign' when l_returnflag = 'A' then 'DDoS' else 'bot' end as ` Label`",
    )


PREPARED = """raw as (select min(l_orderkey * 100000000 + l_partkey * 10 + l_linenumber) over (
        partition by l_orderkey * 100000000 + l_partkey * 10 + l_linenumber) as row_id,
        dayname(l_shipdate) as day, case when l_partkey % 19 = 0 then null else floor(l_quantity)::double end as q,
        case when l_partkey % 23 = 0 then null else floor(l_extendedprice)::double end as p,
        l_linenumber::double as n, case when l_returnflag = 'N' then 'BENIGN' when l_returnflag = 'A' then 'DDoS'
        else 'Bot' end as label from lineitem),
    one as (select row_id, day, q, p, n, label from (select *, row_number() over (
        partition by q, p, n, label order by row_id, day) as i from raw) where i = 1),
    f as (select quantile_cont(q, 0.25) as q1, quantile_cont(q, 0.75) as q3, quantile_cont(p, 0.25) as p1,
                 quantile_cont(p, 0.75) as p3, quantile_cont(n, 0.25) as n1, quantile_cont(n, 0.75) as n3 from one),
    cl as (select row_id, label, case when day = 'Friday' then 'test' else 'train' end as split,
        case when q is not null then least(greatest(q, q1 - 5 * (q3 - q1)), q3 + 5 * (q3 - q1)) end as q,
        case when p is not null then least(greatest(p, p1 - 5 * (p3 - p1)), p3 + 5 * (p3 - p1)) end as p,
        case when n is not null then least(greatest(n, n1 - 5 * (n3 - n1)), n3 + 5 * (n3 - n1)) end as n from one, f),
    md as (select median(q) as q, median(p) as p, median(n) as n from cl where split = 'train'),
    im as (select row_id, label, split, coalesce(cl.q, md.q) as q, coalesce(cl.p, md.p) as p,
                  coalesce(cl.n, md.n) as n from cl, md),
    st as (select avg(q) as mq, stddev_pop(q) as sq, avg(p) as mp, stddev_pop(p) as sp, avg(n) as mn,
                  stddev_pop(n) as sn from im where split = 'train'),
    done as (select row_id, split, label, (q - mq) / sq as q, (p - mp) / sp as p, (n - mn) / sn as n from im, st)"""


@query(
    "prepare_dataset",
    f"""with {PREPARED} select row_id, split, case when label = 'BENIGN' then 0 else 1 end as label_binary,
          round(q, 6) + 0.0 as quantity_s, round(p, 6) + 0.0 as price, round(n, 6) + 0.0 as line from done""",
)
def prepare_dataset(spark, sf_dir):
    done = prepare(raw_flows(spark, sf_dir))
    return rounded(
        done.data.select("row_id", "split", "label_binary", *done.features), *done.features
    )


@query(
    "prepare_dataset_summary",
    f"""with {PREPARED} select split, case label when 'BENIGN' then 0 when 'Bot' then 1 else 2 end as label_multi,
          count(*) as rows, round(avg(q), 4) as quantity_s, round(avg(p), 4) as price, round(avg(n), 4) as line
        from done group by 1, 2""",
)
def prepare_dataset_summary(spark, sf_dir):
    done = prepare(raw_flows(spark, sf_dir), Config().override(task="multiclass"))
    means = [F.round(F.avg(c), 4).alias(c) for c in done.features]
    return done.data.groupBy("split", "label_multi").agg(F.count(F.lit(1)).alias("rows"), *means)


DAYS = ["Friday", "Monday", "Saturday", "Sunday", "Thursday", "Tuesday", "Wednesday"]


def _day_files(spark, sf_dir) -> str:
    """A folder of the raw flows, each day in as many files as tasks wrote."""
    folder = _scratch(spark, "raw")
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    # tasks sort their rows by day: as many of them as the rows need
    flows = raw_flows(spark, sf_dir).hint("rebalance", F.col("row_id")).drop("row_id")
    flows.write.partitionBy("source_file").options(header=True, **spaces).csv(f"{folder}-days")
    for day in DAYS:
        _as_files(spark, f"{folder}-days/source_file={day}", folder, lambda i, day=day: f"{day}-hours-{i:05d}.csv")
    return folder


@query(
    "prepare_folder",
    ORACLES["prepare_dataset_summary"].replace("order by row_id, day) as i", "order by day) as i"),
)
def prepare_folder_summary(spark, sf_dir):
    """From a folder of raw files to written tables and back, with every parameter table read again."""
    folder, out = _day_files(spark, sf_dir), _scratch(spark, "prepared")
    config = Config().override(task="multiclass")
    write_prepared(run_folder(spark, folder, config), out, config)
    codes = {r["label"]: r["code"] for r in tables.load_parameters(spark, out, "label_map").collect()}
    assert codes == {"BENIGN": 0, "Bot": 1, "DDoS": 2}
    features = tables.load_features(spark, out)
    assert {"imputer", "scaler"} <= {n for n in ("imputer", "scaler", "class_weights") if tables.load_parameters(spark, out, n).count()}
    back = None
    for name in ("train", "test"):
        rows = tables.load_split(spark, out, name).withColumn("split", F.lit(name))
        back = rows if back is None else back.unionByName(rows)
    means = [F.round(F.avg(c), 4).alias(c) for c in features]
    return back.groupBy("split", "label_multi").agg(F.count(F.lit(1)).alias("rows"), *means)


@query(
    "prepare_run_summary",
    f"""with {PREPARED}, kept as (select row_id, split, case label when 'BENIGN' then 0 when 'Bot' then 1 else 2 end as y from done),
          tr as (select y, count(*) as n from kept where split = 'train' group by y),
          w as (select y, sum(n) over () / (count(*) over () * n) as weight from tr)
        select 'ingest' as stage, 'rows' as metric, count(*)::varchar as value from lineitem
        union all select 'ingest', 'columns', '5' union all select 'clean', 'rows', count(*)::varchar from one
        union all select 'clean', 'columns', '3' union all select 'labels', 'task_mode', 'multiclass'
        union all select 'labels', 'target', 'label_multi'
        union all select 'split', split, count(*)::varchar from kept group by split
        union all select 'impute', 'strategy', 'median' union all select 'scale', 'scaler', 'standard'
        union all select 'weights', y::varchar, round(weight, 6)::decimal(12, 6)::varchar from w""".replace("order by row_id, day) as i", "order by day) as i"),
)
def prepare_run_summary(spark, sf_dir):
    """What a run from raw files notes about itself, all counted by the jobs that write its tables; seconds left out."""
    done = run_folder(spark, _day_files(spark, sf_dir), Config().override(task="multiclass"))
    exact = F.when(F.col("stage") == "weights", F.round(F.col("value").cast("double"), 6).cast("decimal(12,6)").cast("string"))
    return done.summary_table().filter("stage <> 'run'").withColumn("value", F.coalesce(exact, "value"))


# -- contract ---------------------------------------------------------------------------------------------------------


try:
    import sievewright.llm.queries as _llm
except ModuleNotFoundError as _missing:  # the subpackage may be left out; anything else missing is an error
    if not (_missing.name or "").startswith("sievewright.llm"):
        raise
else:
    QUERIES.update(_llm.QUERIES)
    ORACLES.update(_llm.ORACLES)

try:
    import corpus_pipeline as _corpus
except ModuleNotFoundError as _missing:
    if _missing.name != "corpus_pipeline" and not (_missing.name or "").startswith("sievewright.llm"):
        raise
else:
    QUERIES["pipeline"] = _corpus.run
    if _corpus.ORACLE_SQL:
        ORACLES["pipeline"] = _corpus.ORACLE_SQL


def entry(spark: SparkSession) -> DataFrame:
    """Order lines through the whole preparation, summed up per split and class."""
    return prepare_dataset_summary(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
