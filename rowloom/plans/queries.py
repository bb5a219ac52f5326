"""Each operator on the driver tables: name -> function of (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import rowloom as rl
from rowloom.session import new_folder, written
from rowloom.streaming.store import ChangeStore, store_change_stream
from rowloom.streaming.streams import apply_change_stream, lookup_join, read_folder, read_snapshot, run_available, stream_dedup

from .oracle import WIDE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- grouping -------------------------------------------------------------


@query
def filter_groupby(spark, folder):
    df = table(spark, folder, "orders").transform(rl.chain(
        rl.filter_rows("o_totalprice > 1000"),
        rl.add_column("net", "o_totalprice * 0.8"),
        rl.groupby("o_orderpriority",
                   "SUM(net) AS total, COUNT(o_orderkey) AS n, AVG(o_totalprice) AS mean, MIN(o_totalprice) AS low,"
                   "MAX(o_totalprice) AS high, NUNIQUE(o_custkey) AS customers, STD(o_totalprice) AS sd, VAR(net) AS var"),
    ))
    return rounded(df, 0, "total", "var").transform(lambda d: rounded(d, 2, "mean", "sd"))


@query
def groupby_median(spark, folder):
    df = table(spark, folder, "lineitem").transform(
        rl.groupby("l_returnflag,l_linestatus", "MEDIAN(l_extendedprice) AS mid, MEDIAN(l_quantity) AS mid_quantity"))
    return rounded(df, 3, "mid")


@query
def groupby_median_ranged(spark, folder):
    """The form for groups too wide for one task, forced by its threshold."""
    df = table(spark, folder, "lineitem").transform(
        rl.groupby("l_returnflag,l_linestatus", "MEDIAN(l_extendedprice) AS mid, COUNT(l_tax) AS n", median_values=1))
    return rounded(df, 3, "mid")


@query
def groupby_first_last(spark, folder):
    return table(spark, folder, "events").transform(rl.groupby(
        "user_id", "FIRST(event_type) AS first_type, LAST(event_type) AS last_type, LAST(value) AS last_value",
        order_by="event_id", unique_order=True))


@query
def groupby_empty_keys(spark, folder):
    """Rows with an empty key are dropped; NULL is one value of NUNIQUE and none of COUNT."""
    return table(spark, folder, "events").transform(rl.chain(
        rl.add_column("kind", "if(event_type = 'error', '', if(event_type = 'view', null, event_type))", sql=True),
        rl.add_column("what", "if(value < 10, null, cast(floor(value) as bigint))", sql=True),
        rl.groupby("kind", "COUNT(what) AS n, NUNIQUE(what) AS different")))


@query
def aggregate(spark, folder):
    df = table(spark, folder, "lineitem").transform(rl.aggregate(
        "l_returnflag,l_linestatus", "SUM(l_quantity),AVG(l_extendedprice),MIN(l_discount),MAX(l_tax),COUNT(l_orderkey)"))
    return rounded(df, 2, "SUM_l_quantity", "AVG_l_extendedprice")


@query
def aggregate_text_numbers(spark, folder):
    """Text that is no number counts as 0."""
    return table(spark, folder, "part").transform(rl.chain(
        rl.add_column("size", "if(p_size % 5 = 0, p_type, cast(p_size as string))", sql=True),
        rl.aggregate("p_brand", "SUM(size),MIN(size),MAX(size),COUNT(size)")))


@query
def pivot_count(spark, folder):
    return table(spark, folder, "events").transform(rl.pivot("user_id", "event_type", "value", "COUNT"))


@query
def pivot_sum(spark, folder):
    df = table(spark, folder, "lineitem").transform(
        rl.pivot("l_suppkey", "l_returnflag", "l_quantity", "SUM", values=["A", "N", "R"]))
    return rounded(df, 2, "A", "N", "R")


@query
def unpivot(spark, folder):
    return table(spark, folder, "supplier").transform(rl.unpivot("s_name,s_nationkey", "field", "content")).select(
        "s_suppkey", "field", "content")


@query
def unpivot_numbers(spark, folder):
    df = table(spark, folder, "lineitem").transform(rl.chain(
        rl.select("l_returnflag,l_quantity,l_discount,l_tax"), rl.unpivot("l_quantity,l_discount,l_tax", "measure", "amount"),
        rl.groupby("l_returnflag,measure", "SUM(amount) AS total, COUNT(amount) AS n")))
    return rounded(df, 2, "total")


# ---- columns --------------------------------------------------------------


@query
def select_rename_cast(spark, folder):
    return table(spark, folder, "orders").transform(rl.chain(
        rl.select("o_orderkey,o_totalprice,o_orderstatus,not_there"),
        rl.rename("o_orderkey:id,o_totalprice:price,unknown:x"),
        rl.cast("id", "string"), rl.casts({"price": "int"})))


@query
def cast_text(spark, folder):
    """Text of mixed content: values that do not fit become NULL."""
    return table(spark, folder, "part").transform(rl.chain(
        rl.add_column("t", "case p_size % 4 when 0 then p_brand when 1 then cast(p_size as string) "
                           "when 2 then cast(p_retailprice as string) else 'true' end", sql=True),
        rl.add_column("i", "t", sql=True), rl.add_column("f", "t", sql=True), rl.add_column("b", "t", sql=True),
        rl.casts({"i": "int", "f": "float", "b": "bool"}, errors="null"), rl.select("p_partkey,i,f,b")))


@query
def add_column(spark, folder):
    df = table(spark, folder, "lineitem").transform(rl.chain(
        rl.add_column("half", "l_extendedprice * 0.5"), rl.add_column("each", "l_extendedprice / l_quantity"),
        rl.add_column("label", "'item'"), rl.add_column("copy", "l_linenumber"), rl.add_column("less", "l_quantity - l_discount"),
        rl.add_column("more", "l_quantity + l_tax"),
        rl.select("l_orderkey,l_linenumber,l_partkey,half,each,label,copy,less,more")))
    return rounded(df, 8, "half", "each", "less", "more")


@query
def auto_field(spark, folder):
    text = table(spark, folder, "part").select(*[F.col(c).cast("string").alias(c) for c in (
        "p_partkey", "p_name", "p_size", "p_retailprice")], F.when(F.col("p_size") > 25, "true").otherwise("F").alias("large"))
    return text.transform(rl.auto_field())


@query
def fillna_value(spark, folder):
    return table(spark, folder, "events").transform(rl.chain(
        rl.add_column("v", "if(value < 10, null, value)", sql=True),
        rl.add_column("t", "case event_type when 'error' then '' when 'view' then 'NaN' when 'click' then null else event_type end", sql=True),
        rl.fillna(-1, "v"), rl.fillna("none", "t"), rl.select("event_id,v,t")))


# ---- cleaning -------------------------------------------------------------


@query
def data_cleansing(spark, folder):
    return table(spark, folder, "documents").transform(rl.chain(
        rl.data_cleansing("text", trim=True, to_lower=True, remove_special=True, nullify_empty=True),
        rl.add_column("digest", "md5(text)", sql=True), rl.add_column("chars", "cast(length(text) as bigint)", sql=True),
        rl.select("doc_id,digest,chars")))


@query
def find_replace(spark, folder):
    return table(spark, folder, "pages").transform(rl.chain(
        rl.select("page_id,url"), rl.add_column("scheme", "url"), rl.add_column("host", "url"), rl.add_column("lang", "url"),
        rl.find_replace("scheme", "http://", "https://"),
        rl.find_replace("host", r"^https?://([^/]+)/.*$", "<$1>", "regex"),
        rl.regex("url", "/(fr|en|de|es)/", output="lang"),
        rl.find_replace("lang", "fr", "french", "exact")))


@query
def regex_extract(spark, folder):
    return table(spark, folder, "pages").transform(rl.chain(
        rl.regex("html", "<title>([^<]*)</title>", output="title"), rl.regex("html", "[0-9]", output="no_group"),
        rl.regex("url", r"(?P<number>\d+)", "replace", "<${number}>"), rl.select("page_id,title,no_group,url")))


@query
def regex_match(spark, folder):
    return table(spark, folder, "documents").transform(rl.chain(
        rl.regex("text", r"[[:digit:]]{3}\s", "match"), rl.groupby("lang,source", "COUNT(doc_id) AS n")))


@query
def text_to_columns(spark, folder):
    return table(spark, folder, "part").transform(rl.chain(
        rl.select("p_partkey,p_name,p_brand"), rl.text_to_columns("p_name", " "),
        rl.text_to_columns("p_brand", "#", "b", max_split=3)))


@query
def datetime_typed(spark, folder):
    steps = [rl.datetime("o_orderdate", "format", output_format="02/01/2006", output="shown"),
             rl.datetime("o_orderdate", "add", add_value=10, output="later"),
             rl.datetime("later", "diff", other="o_orderdate", unit="hours", output="hours"),
             rl.datetime("later", "add", add_unit="minutes", add_value=90, output_format="2006-01-02 15:04:05", output="later")]
    steps += [rl.datetime("o_orderdate", "extract", extract=p, output=p) for p in ("year", "month", "day", "weekday", "hour")]
    return table(spark, folder, "orders").transform(rl.chain(
        *steps, rl.select("o_orderkey,shown,later,hours,year,month,day,weekday,hour")))


@query
def datetime_text(spark, folder):
    """Text dates; priorities mixed in stay as they are."""
    return table(spark, folder, "orders").transform(rl.chain(
        rl.add_column("d", "if(o_orderstatus = 'F', o_orderpriority, date_format(o_orderdate, 'yyyy/MM/dd HH:mm'))", sql=True),
        rl.datetime("d", "add", input_format="2006/01/02 15:04", output_format="2006-01-02T15:04:05", add_unit="hours",
                    add_value=30),
        rl.select("o_orderkey,d")))


# ---- rows -----------------------------------------------------------------


@query
def filter_text(spark, folder):
    return table(spark, folder, "orders").transform(rl.chain(
        rl.filter_rows("o_orderstatus == 'F'"), rl.filter_rows('o_orderpriority != "5-LOW"'),
        rl.filter_rows("o_totalprice <= 250000"), rl.select("o_orderkey,o_orderstatus,o_orderpriority,o_totalprice")))


@query
def filter_advanced(spark, folder):
    df = table(spark, folder, "events").withColumn("v", F.expr("if(value < 10, null, value)"))
    tests = [("v", "gte", "50", "number"), ("event_type", "contains", "i", "string"), ("event_type", "not_contains", "e", "string"),
             ("event_type", "starts_with", "e", "string"), ("event_type", "ends_with", "k", "string"), ("v", "is_null", "", "string"),
             ("v", "is_not_null", "", "string"), ("event_type", "gt", "error", "string"), ("v", "neq", "12.31", "number"),
             ("user_id", "is_true", "", "bool"), ("v", "eq", "12.31", "number"), ("v", "lt", "30", "number"), ("v", "lte", "30", "number"),
             ("user_id", "is_false", "", "bool")]
    matched = df.transform(rl.match_advanced(tests))
    labels = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(o).alias("operator")) for f, o, _, _ in tests])
    tests_of = matched.select("event_id", F.explode(F.arrays_zip(F.col("_match"), labels.alias("label"))).alias("t"))
    return tests_of.groupBy("t.label.field", "t.label.operator", F.col("t._match").cast("string").alias("branch")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query
def filter_advanced_outputs(spark, folder):
    """Both outputs of one test."""
    kept, rest = rl.filter_advanced(table(spark, folder, "events"), "value", "lt", "20", "number")
    return rl.union(*[d.select("event_id", F.lit(i).alias("output")) for i, d in enumerate((kept, rest))])


@query
def filter_quoted_operator(spark, folder):
    """A literal that holds an operator and a comma."""
    df = table(spark, folder, "orders").withColumn("tag", F.concat("o_orderstatus", F.lit("==a, >="), F.pmod("o_orderkey", F.lit(3))))
    outputs = rl.split(df, "tag != 'F==a, >=1', o_totalprice > 100000")
    return rl.union(*[d.select("o_orderkey", F.lit(i).alias("output")) for i, d in enumerate(outputs)])


@query
def filter_rules(spark, folder):
    return table(spark, folder, "orders").transform(rl.chain(
        rl.filter_rules([("o_orderpriority", "gt", "2"), ("o_orderpriority", "lt", "5"), ("o_orderstatus", "neq", "O")]),
        rl.select("o_orderkey,o_orderpriority,o_orderstatus")))


@query
def split_outputs(spark, folder):
    """All outputs of a split, from one pass: the number that `split` filters on."""
    routed = table(spark, folder, "events").transform(rl.route("value > 60, value > 20, event_type == 'click'", "output"))
    return routed.select("event_id", "output")


@query
def route(spark, folder):
    df = table(spark, folder, "lineitem").transform(rl.chain(
        rl.route("l_quantity > 40, l_discount > 0.05"), rl.groupby("_route", "COUNT(l_orderkey) AS n, SUM(l_quantity) AS q")))
    return rounded(df, 2, "q")


@query
def fork(spark, folder):
    """The same rows on two ways, put together again."""
    a, b = rl.fork(rl.dummy(table(spark, folder, "supplier")), 2)
    return rl.union(a.transform(rl.add_column("way", "'a'")), b.transform(rl.add_column("way", "'b'")))


@query
def row_counts(spark, folder):
    """Rows seen before and after a filter, counted while the rows pass."""
    before, seen = rl.counted(table(spark, folder, "orders"), "before")
    after, kept = rl.counted(before.transform(rl.filter_rows("o_totalprice > 250000")), "after")
    after.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([("before", seen.get["rows"]), ("after", kept.get["rows"])], "step string, n bigint")


@query
def dedup_keys(spark, folder):
    return table(spark, folder, "lineitem").transform(rl.chain(rl.select("l_partkey,l_suppkey"), rl.dedup()))


@query
def drop_duplicates_first(spark, folder):
    return table(spark, folder, "events").transform(rl.chain(
        rl.drop_duplicates("user_id,event_type", "first", "event_id", unique_order=True), rl.select("event_id,user_id,event_type,value")))


@query
def drop_duplicates_last(spark, folder):
    return table(spark, folder, "conversations").transform(rl.chain(
        rl.drop_duplicates("conv_id", "last", "turn"), rl.select("conv_id,turn,role")))


@query
def drop_duplicates_none(spark, folder):
    return table(spark, folder, "documents").transform(rl.chain(
        rl.drop_duplicates("text", keep=False), rl.select("doc_id,lang,source")))


@query
def drop_duplicates_indexed(spark, folder):
    return table(spark, folder, "events").transform(rl.chain(
        rl.drop_duplicates("user_id", "last", "event_id", ignore_index=True, unique_order=True),
        rl.select("_index,event_id,user_id")))


@query
def sort_top(spark, folder):
    return table(spark, folder, "lineitem").transform(rl.chain(
        rl.sort("l_extendedprice desc, l_orderkey, l_partkey, l_linenumber", limit=100),
        rl.select("l_orderkey,l_partkey,l_linenumber,l_extendedprice")))


@query
def sort_text_numbers(spark, folder):
    """Text sorted as numbers where it holds numbers; the order shows in the index of the first 50."""
    return table(spark, folder, "part").transform(rl.chain(
        rl.add_column("t", "if(p_size > 45, p_name, cast(p_size as string))", sql=True),
        rl.sort("t, p_partkey", limit=50), rl.select("p_partkey,t")))


@query
def row_index(spark, folder):
    return table(spark, folder, "orders").transform(rl.chain(
        rl.row_index("o_totalprice desc, o_orderkey", unique_order=True, stable=True), rl.select("o_orderkey,_index")))


@query
def row_index_with_ties(spark, folder):
    """Many rows per order value: the index ranges of each value are fixed, whatever the ties."""
    return table(spark, folder, "lineitem").transform(rl.row_index("l_returnflag, l_linestatus")).groupBy(
        "l_returnflag", "l_linestatus").agg(F.min("_index").alias("first"), F.max("_index").alias("last"),
                                            F.count_distinct("_index").alias("n"))


@query
def sampling_first(spark, folder):
    return table(spark, folder, "events").transform(rl.chain(
        rl.sampling("first", 100, order_by="value desc, event_id", unique_order=True), rl.select("event_id,value")))


@query
def sampling_every(spark, folder):
    return table(spark, folder, "events").transform(rl.chain(
        rl.sampling("every", 10, order_by="ts, event_id", unique_order=True, stable=True), rl.select("event_id,user_id")))


@query
def sampling_percent(spark, folder):
    return table(spark, folder, "orders").transform(rl.chain(
        rl.sampling("percent", 20, key="o_custkey", seed=1), rl.select("o_orderkey,o_custkey")))


@query
def union_by_name(spark, folder):
    customers = table(spark, folder, "customer").transform(rl.rename("c_name:name,c_nationkey:nation,c_acctbal:balance"))
    suppliers = table(spark, folder, "supplier").transform(rl.rename("s_name:name,s_nationkey:nation,s_acctbal:balance"))
    return rl.union(customers, suppliers)


@query
def ffill(spark, folder):
    return _gaps(spark, folder).transform(rl.ffill("event_id", "v,t", unique_order=True, stable=True))


@query
def ffill_written(spark, folder):
    """The form for any input: ranges over a written table."""
    return _gaps(spark, folder).transform(rl.ffill("event_id", "v,t", unique_order=True))


@query
def ffill_limit_per_user(spark, folder):
    return _gaps(spark, folder).transform(rl.ffill("event_id", "v,t", 1, partition_by="user_id", unique_order=True))


@query
def ffill_hot_users(spark, folder):
    """Every user counts as too large for one task, so all are cut into slices."""
    return _gaps(spark, folder).transform(
        rl.ffill("event_id", "v,t", 1, partition_by="user_id", unique_order=True, stable=True, hot_rows=1))


@query
def ffill_hot_users_written(spark, folder):
    """The same through ranges over a written table."""
    return _gaps(spark, folder).transform(rl.ffill("event_id", "v,t", 1, partition_by="user_id", unique_order=True, hot_rows=1))


@query
def bfill(spark, folder):
    return _gaps(spark, folder).transform(rl.bfill("event_id", "v,t", 2, unique_order=True, stable=True))


def _gaps(spark, folder):
    return table(spark, folder, "events").transform(rl.chain(
        rl.add_column("v", "if(value < 25, null, value)", sql=True),
        rl.add_column("t", "case event_type when 'error' then '' when 'view' then null else event_type end", sql=True),
        rl.select("event_id,user_id,v,t")))


# ---- joins ----------------------------------------------------------------


@query
def join_inner(spark, folder):
    orders = table(spark, folder, "orders").transform(rl.select("o_orderkey,o_custkey,o_totalprice"))
    customers = table(spark, folder, "customer").transform(rl.select("c_custkey,c_name,c_mktsegment"))
    return rl.join(orders, customers, "o_custkey", "c_custkey")


@query
def join_aggregated(spark, folder):
    nations = table(spark, folder, "nation").transform(rl.select("n_nationkey,n_name"))
    customers = table(spark, folder, "customer").transform(rl.select("c_custkey,c_nationkey"))
    orders = table(spark, folder, "orders").transform(rl.select("o_custkey,o_totalprice"))
    joined = rl.join(rl.join(orders, customers, "o_custkey", "c_custkey"), nations, "c_nationkey", "n_nationkey")
    return rounded(joined.transform(rl.groupby("n_name", "SUM(o_totalprice) AS total, COUNT(o_custkey) AS n")), 0, "total")


@query
def join_left(spark, folder):
    documents = table(spark, folder, "documents").transform(rl.select("doc_id,lang"))
    return rl.join(documents, table(spark, folder, "labels"), "doc_id", "doc_id", "left")


@query
def join_right(spark, folder):
    return rl.join(table(spark, folder, "labels"), table(spark, folder, "documents").transform(rl.select("doc_id,lang")),
                   "doc_id", "doc_id", "right")


def _shifted(spark, folder):
    customers = table(spark, folder, "customer").transform(rl.select("c_custkey,c_name"))
    parts = table(spark, folder, "part").select((F.col("p_partkey") - 700).alias("k"), F.col("p_name").alias("c_name"))
    return customers, parts


@query
def join_full(spark, folder):
    return rl.join(*_shifted(spark, folder), "c_custkey", "k", "full")


@query
def join_full_hot_sides(spark, folder):
    """Inner join plus both sides' rows without a partner."""
    return rl.join(*_shifted(spark, folder), "c_custkey", "k", "full", split_hot=True)


def _mixed(spark, folder, how, split_hot):
    """A bigint key against a double key with fractions."""
    parts = table(spark, folder, "part").select((F.col("p_partkey") / 2).alias("k"), "p_name")
    return rl.join(table(spark, folder, "customer").select("c_custkey", "c_name"), parts, "c_custkey", "k", how, split_hot=split_hot, stable=True)


@query
def join_full_mixed_keys(spark, folder):
    return _mixed(spark, folder, "full", False)


@query
def join_full_mixed_keys_split(spark, folder):
    return _mixed(spark, folder, "full", True)


@query
def join_right_mixed_keys(spark, folder):
    return _mixed(spark, folder, "right", False)


@query
def join_right_mixed_keys_split(spark, folder):
    return _mixed(spark, folder, "right", True)


@query
def join_int_keys(spark, folder):
    """An int key against a bigint key that passes its range; customers whose keys pass it too are joined as bigint first."""
    orders = table(spark, folder, "orders").select((F.col("o_orderkey") * 1_000_000).alias("k"), "o_orderstatus")
    customers = table(spark, folder, "customer").select((F.col("c_custkey") * 1_000_000).alias("c"), "c_name")
    fits = F.coalesce(F.col("c").between(-(2**31), 2**31 - 1), F.lit(True))
    others = rl.join(orders, customers.filter(~fits), "k", "c", "full")
    joined = rl.join(customers.filter(fits).withColumn("c", F.col("c").cast("int")), others, "c", "k", "full")
    return joined.select("c", F.coalesce("c_name", "right_c_name").alias("c_name"), "o_orderstatus")


@query
def merge_inner(spark, folder):
    customers, parts = _shifted(spark, folder)
    return rl.merge(customers, parts, "inner", left_on="c_custkey", right_on="k", left_suffix="_c", right_suffix="_p")


@query
def merge_right(spark, folder):
    customers, parts = _shifted(spark, folder)
    return rl.merge(customers, parts, "right", left_on="c_custkey", right_on="k", left_suffix="_c", right_suffix="_p")


@query
def map_columns(spark, folder):
    return table(spark, folder, "supplier").transform(rl.map_columns({"s_name": "name", "s_nationkey": "nation"}))


@query
def text_input_lookup(spark, folder):
    """Typed-in text as a lookup table for the nations."""
    lookup = rl.text_input(spark, "key,continent\n0,Africa\n1,America\n2,Asia\n3,Europe")
    return rl.join(table(spark, folder, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("r")), lookup, "r", "key", "left")


@query
def sampling_all_rows_small_share(spark, folder):
    return table(spark, folder, "lineitem").transform(rl.chain(
        rl.sampling("percent", 0.5, key="l_orderkey,l_linenumber"), rl.select("l_orderkey,l_linenumber")))


@query
def csv_many_headers(spark, folder):
    """Files with their columns in two orders."""
    path = new_folder(spark, "csv")
    customers = table(spark, folder, "customer")
    rl.write_csv(customers.where("c_custkey % 2 = 0"), f"{path}/a", columns="c_custkey,c_name,c_mktsegment")
    rl.write_csv(customers.where("c_custkey % 2 = 1"), f"{path}/b", columns="c_mktsegment,c_custkey,c_name")
    return rl.read_csv(spark, f"{path}/*")


@query
def csv_letters(spark, folder):
    """Generated names for files without a header."""
    path = new_folder(spark, "csv")
    rl.write_csv(table(spark, folder, "supplier"), path, columns="s_suppkey,s_name")
    return rl.read_csv(spark, path, has_header=False, auto_names="letters").where("A != 's_suppkey'")


@query
def csv_preview_all(spark, folder):
    """A preview of more rows than there are is all rows."""
    path = new_folder(spark, "csv")
    rl.write_csv(table(spark, folder, "nation"), path, columns="n_nationkey,n_name")
    return rl.csv_preview(spark, path, limit=500)


@query
def apply_changes_strict(spark, folder):
    """Operations in any case; all of them are checked."""
    changes = _change_rows(table(spark, folder, "events")).withColumn("_op", F.lower("_op"))
    return rl.apply_changes(_snapshot(spark, folder), changes, "id", "event_id")


@query
def sort_all(spark, folder):
    """A whole table in order; the index counts the rows as they stand in the sorted output."""
    ordered = table(spark, folder, "lineitem").transform(rl.sort("l_shipdate desc, l_quantity, l_orderkey, l_linenumber", unique_order=True))
    placed = written(ordered.select("l_orderkey", "l_linenumber", F.monotonically_increasing_id().alias("place")), "sorted")
    return placed.transform(rl.row_index("place", "i", unique_order=True)).drop("place")


@query
def join_null_keys(spark, folder):
    """NULL keys equal each other."""
    left = table(spark, folder, "nation").select(F.expr("if(n_regionkey = 1, null, n_regionkey)").alias("k"), "n_name")
    right = table(spark, folder, "region").select(F.expr("if(r_regionkey = 1, null, r_regionkey)").alias("k2"), "r_name")
    return rl.join(left, right, "k", "k2", "left")


@query
def merge_outer(spark, folder):
    customers, parts = _shifted(spark, folder)
    return rl.merge(customers, parts, "outer", left_on="c_custkey", right_on="k", left_suffix="_c", right_suffix="_p")


@query
def merge_validated(spark, folder):
    orders = table(spark, folder, "orders").transform(rl.rename("o_custkey:key,o_totalprice:amount"))
    customers = table(spark, folder, "customer").transform(rl.rename("c_custkey:key,c_acctbal:amount"))
    return rl.merge(orders, customers, "left", on="key", validate="many_to_one").transform(
        rl.select("o_orderkey,key,amount_x,amount_y,c_name"))


@query
def append_fields(spark, folder):
    customers = table(spark, folder, "customer").transform(rl.select("c_custkey,c_acctbal"))
    suppliers = table(spark, folder, "supplier").transform(rl.select("s_suppkey,s_name"))
    return rl.append_fields(customers, suppliers, "c_acctbal desc, c_custkey", "s_suppkey", unique_order=True, stable=True)


# ---- profiling and models -------------------------------------------------


@query
def field_summary(spark, folder):
    df = table(spark, folder, "lineitem").transform(rl.field_summary("l_orderkey,l_quantity,l_extendedprice,l_returnflag,l_shipdate"))
    return rounded(df, 2, "mean")


@query
def field_summary_text(spark, folder):
    df = table(spark, folder, "part").transform(rl.chain(
        rl.add_column("t", "case p_size % 3 when 0 then null when 1 then p_type else cast(p_size as string) end", sql=True),
        rl.field_summary("t,p_name")))
    return rounded(df, 4, "mean")


@query
def frequency_table(spark, folder):
    return table(spark, folder, "lineitem").transform(rl.frequency_table("l_linenumber"))


@query
def correlation(spark, folder):
    return table(spark, folder, "lineitem").transform(rl.correlation("l_quantity,l_extendedprice,l_discount,l_tax"))


@query
def correlation_pairwise(spark, folder):
    """Missing values and a constant column."""
    df = table(spark, folder, "lineitem").select(
        F.expr("if(l_quantity < 10, null, l_quantity)").alias("a"), F.expr("if(l_discount > 0.08, null, l_extendedprice)").alias("b"),
        F.lit(3.0).alias("c"))
    return df.transform(rl.correlation())


@query
def regression(spark, folder):
    df = table(spark, folder, "lineitem").transform(rl.chain(
        rl.regression("l_quantity", "l_extendedprice"),
        rl.select("l_orderkey,l_partkey,l_linenumber,l_quantity,predicted,slope,intercept,r2")))
    return rounded(rounded(df, 2, "predicted", "intercept"), 4, "slope", "r2")


@query
def naive_bayes(spark, folder):
    return table(spark, folder, "lineitem").transform(rl.chain(
        rl.naive_bayes("l_quantity,l_extendedprice,l_discount,l_tax", "l_returnflag"),
        rl.select("l_orderkey,l_partkey,l_linenumber,l_returnflag,predicted_class")))


@query
def naive_bayes_many_classes(spark, folder):
    """As many classes as users, so more than one block of classes."""
    return table(spark, folder, "events").transform(rl.chain(
        rl.naive_bayes("value", "user_id", "likely_user"), rl.select("event_id,user_id,likely_user")))


# ---- changes, sources, sinks ----------------------------------------------


def _change_rows(events):
    return events.select(
        "event_id", F.expr("case event_type when 'signup' then 'INSERT' when 'error' then 'DELETE' else 'UPDATE' end").alias("_op"),
        F.col("user_id").alias("id"), F.col("event_type").alias("label"), F.col("value").alias("amount"))


def _snapshot(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), F.col("c_acctbal").alias("amount"))


@query
def apply_changes(spark, folder):
    return rl.apply_changes(_snapshot(spark, folder), _change_rows(table(spark, folder, "events")), "id", "event_id")


@query
def upsert(spark, folder):
    newer = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.lit("SUPPLIER").alias("label"), F.col("s_acctbal").alias("amount"))
    return rl.upsert(_snapshot(spark, folder), newer, "id")


@query
def json_records(spark, folder):
    return rl.explode_records(table(spark, folder, "events"), "props", "k bigint", keep=["event_id"])


@query
def json_pages(spark, folder):
    """Events stored as numbered response bodies of 500 records, then read back page by page."""
    path = new_folder(spark, "pages")
    pages = table(spark, folder, "events").select(
        F.floor(F.col("event_id") / 500).alias("page"), F.struct("event_id", "user_id", "event_type").alias("record"))
    bodies = pages.groupBy("page").agg(F.to_json(F.struct(F.collect_list("record").alias("items"))).alias("value"))
    bodies.write.partitionBy("page").text(path)
    return rl.json_pages(spark, path, "event_id bigint, user_id bigint, event_type string", "items", page_size=500,
                         page_pattern=r"page=(\d+)")


@query
def csv_round_trip(spark, folder):
    path = new_folder(spark, "csv")
    rl.write_csv(table(spark, folder, "customer"), path, ";")
    return rl.read_csv(spark, path, ";")


@query
def csv_quoted_text(spark, folder):
    """Text with quotes, delimiters and line breaks survives."""
    path = new_folder(spark, "csv")
    rl.write_csv(table(spark, folder, "documents"), path, columns="doc_id,text,lang")
    return rl.read_csv(spark, path, trim_leading_space=False).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("digest"), "lang")


@query
def csv_scan(spark, folder):
    base = new_folder(spark, "csv")
    for name, delimiter in (("orders", ";"), ("part", "|"), ("supplier", "\t"), ("customer", ",")):
        rl.write_csv(table(spark, folder, name), f"{base}/{name}", delimiter)
    found = rl.csv_scan(spark, f"{base}/*", "*.csv")
    return found.select(F.array_join("headers", " ").alias("columns"), "encoding", "delimiter", "newline", "has_header",
                        F.col("detected_columns").cast("bigint").alias("width"), "confidence").distinct()


@query
def directory(spark, folder):
    return rl.directory(spark, folder, "*.parquet").select("name", "extension", "size")


@query
def browse(spark, folder):
    return table(spark, folder, "orders").transform(rl.chain(
        rl.select("o_orderkey,o_orderstatus,o_totalprice"), rl.sampling("first", 1000, order_by="o_orderkey", unique_order=True),
        rl.browse))


# ---- streams --------------------------------------------------------------


def _stream(spark, folder, name):
    # A glob, since the table may be one file or a folder of files.
    return read_folder(spark, f"{folder}/{name}.parquet*", table(spark, folder, name).schema)


@query
def stream_steps(spark, folder):
    return run_available(_stream(spark, folder, "orders").transform(rl.chain(
        rl.filter_rows("o_totalprice > 100000"), rl.add_column("net", "o_totalprice - 1000"),
        rl.datetime("o_orderdate", "extract", extract="year", output="year"), rl.route("net > 300000"),
        rl.select("o_orderkey,net,year,_route")))).withColumn("net", F.round("net", 2))


@query
def stream_first_per_key(spark, folder):
    events = _stream(spark, folder, "events")
    return run_available(stream_dedup(events, "user_id,event_type", "ts", "400 days")).select("user_id", "event_type")


@query
def stream_lookup(spark, folder):
    lines = _stream(spark, folder, "lineitem").transform(rl.select("l_orderkey,l_linenumber,l_partkey"))
    parts = table(spark, folder, "part").transform(rl.select("p_partkey,p_name"))
    return run_available(lookup_join(lines, parts, "l_partkey", "p_partkey", "left"))


@query
def stream_changes(spark, folder):
    path = new_folder(spark, "snapshot")
    _snapshot(spark, folder).write.parquet(f"{path}/version=start")
    landed = new_folder(spark, "changes")
    # the changes come in several batches, out of order
    _change_rows(table(spark, folder, "events")).repartition(5, F.xxhash64("event_id")).write.parquet(landed)
    changes = read_folder(spark, landed, spark.read.parquet(landed).schema, files_per_trigger=1)
    apply_change_stream(changes, path, "id", "event_id", new_folder(spark, "changes-state"), available_now=True).awaitTermination()
    return read_snapshot(spark, path)


@query
def change_store(spark, folder):
    """Changes brought into a bucketed store in three batches out of order, one of them twice, with a compaction between."""
    store = ChangeStore.create(_snapshot(spark, folder), new_folder(spark, "store"), "id", "bigint", 8)
    changes = _change_rows(table(spark, folder, "events"))
    for i in (2, 0, 0, 1):
        store.apply(changes.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i), "event_id", stream="events", batch={2: 0, 0: 1, 1: 2}[i])
        if i == 0:
            store.compact()
    return store.read()


@query
def change_store_streams(spark, folder):
    """Two streams with checkpoints of their own bring their parts of the changes into one store."""
    store = ChangeStore.create(_snapshot(spark, folder), new_folder(spark, "store"), "id", "bigint", 4)
    changes = _change_rows(table(spark, folder, "events"))
    for i in range(2):
        landed = new_folder(spark, "changes")
        changes.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == i).repartition(2).write.parquet(landed)
        stream = read_folder(spark, landed, changes.schema, files_per_trigger=1)
        store_change_stream(stream, store, "event_id", new_folder(spark, "changes-state"), available_now=True).awaitTermination()
    return store.read()


@query
def groupby_medians_ranged(spark, folder):
    """Two exact medians of groups of any size from one count per digit."""
    df = table(spark, folder, "lineitem").transform(
        rl.groupby("l_returnflag,l_linestatus", "MEDIAN(l_extendedprice) AS mid, MEDIAN(l_discount) AS mid_discount, SUM(l_quantity) AS total", median_values=1))
    return rounded(df, 3, "mid", "mid_discount", "total")


@query
def sort_text_numbers_all(spark, folder):
    """A whole table in the order of text that holds numbers; the index counts the rows as they stand in the output."""
    ordered = table(spark, folder, "part").transform(rl.chain(
        rl.add_column("t", "if(p_size > 45, p_name, cast(p_size as string))", sql=True),
        rl.sort("t, p_partkey", limit=100_000_000), rl.select("p_partkey,t")))  # a limit beyond one task's
    placed = written(ordered.withColumn("place", F.monotonically_increasing_id()), "sorted")
    return placed.transform(rl.row_index("place", "i", unique_order=True)).drop("place")


@query
def correlation_many_columns(spark, folder):
    """Over a hundred pairs in one scan: prices far from zero, missing values, a constant."""
    df = table(spark, folder, "lineitem").select(*[F.expr(e).alias(f"c{i:02d}") for i, e in enumerate(WIDE)])
    return df.transform(rl.correlation())


@query
def join_large_keys(spark, folder):
    """64-bit keys beyond 2**53 against floats: only the same number is equal."""
    left = table(spark, folder, "orders").select((F.col("o_orderkey") + 9007199254740992).alias("k"), "o_custkey")
    right = table(spark, folder, "lineitem").select((F.col("l_orderkey").cast("double") * 2 + 9007199254740992.0).alias("k2"), "l_linenumber")
    return rl.join(left, right, "k", "k2", "inner").select(F.col("k").cast("bigint").alias("k"), "o_custkey", "l_linenumber")


@query
def json_strict_types(spark, folder):
    """Fields of another type are NULL where that is asked for; otherwise they would fail the job."""
    bodies = table(spark, folder, "events").select("event_id", F.concat(
        F.lit('[{"k": '), F.expr("if(event_id % 3 = 0, concat('\"', event_type, '\"'), cast(user_id as string))"), F.lit(', "t": "'), "event_type", F.lit('"}]')).alias("body"))
    return rl.explode_records(bodies, "body", "k bigint, t string", keep=["event_id"], errors="null")


@query
def data_grid_lookup(spark, folder):
    """Rows typed in by hand joined to a table."""
    grid = rl.data_grid(spark, '["code","meaning"]', '[["F","finished"],["O","open"],["X","unused"]]')
    return rl.join(table(spark, folder, "orders").transform(rl.select("o_orderkey,o_orderstatus")), grid, "o_orderstatus", "code", "left")


@query
def preview_steps(spark, folder):
    """The first rows of a sorted table after each of two steps."""
    ordered = table(spark, folder, "orders").transform(rl.chain(rl.select("o_orderkey,o_totalprice"), rl.sort("o_orderkey", limit=1000, unique_order=True)))
    first = rl.preview(ordered, 5).withColumn("step", F.lit("sorted"))
    second = rl.preview(ordered.transform(rl.chain(rl.filter_rows("o_totalprice > 100000"), rl.sort("o_orderkey", limit=1000, unique_order=True))), 5)
    return first.unionByName(second.withColumn("step", F.lit("filtered")))


@query
def auto_field_mixed(spark, folder):
    """Numbers, words and truths in one column, each value with its own type."""
    df = table(spark, folder, "part").select("p_partkey", F.expr(
        "case p_partkey % 4 when 0 then cast(p_size as string) when 1 then cast(p_retailprice as string) when 2 then 'true' else p_name end").alias("v"))
    out = df.transform(rl.auto_field("v", mixed="variant"))
    return out.select("p_partkey", F.lower(F.schema_of_variant("v")).alias("kind"), F.try_variant_get("v", "$", "bigint").alias("whole"),
                      F.when(F.col("p_partkey") % 4 == 3, F.variant_get("v", "$", "string")).alias("words"))


@query
def sketches_merged(spark, folder):
    """Sketches of the days, stored and merged by kind of event, are within three standard errors of the exact numbers."""
    spec = "NUNIQUE(user_id) AS users, MEDIAN(value) AS mid"
    events = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    stored = written(events.transform(rl.sketch_groups("event_type,day", spec)), "sketches")
    found = stored.transform(rl.chain(rl.merge_sketches("event_type", spec), rl.estimate_sketches(spec)))
    exact = events.groupBy(F.col("event_type").alias("kind")).agg(
        F.count_distinct("user_id").alias("n"), F.percentile("value", [0.48, 0.52]).alias("around"))
    near = F.abs(F.col("users") - F.col("n")) <= F.greatest(0.048 * F.col("n"), F.lit(1))
    return found.join(exact, F.col("event_type") == F.col("kind")).select(
        "event_type", near.alias("users_near"), F.col("mid").between(F.col("around")[0], F.col("around")[1]).alias("mid_near"))
