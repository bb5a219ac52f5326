"""The same results in DuckDB SQL over the driver tables."""

from __future__ import annotations

GAPS = """SELECT event_id, user_id, CASE WHEN value < 25 THEN NULL ELSE value END AS v,
       CASE event_type WHEN 'error' THEN '' WHEN 'view' THEN NULL ELSE event_type END AS t FROM events"""

SNAPSHOT = "SELECT c_custkey AS id, c_mktsegment AS label, c_acctbal AS amount FROM customer"

CHANGED = f"""
WITH snap AS ({SNAPSHOT}), last AS (
  SELECT user_id AS id, arg_max(event_type, event_id) AS label, arg_max(value, event_id) AS amount FROM events GROUP BY user_id)
SELECT * FROM snap WHERE id NOT IN (SELECT id FROM last)
UNION ALL SELECT id, label, amount FROM last WHERE label <> 'error'"""

SHIFTED = "SELECT p_partkey - 700 AS k, p_name FROM part"

FULL = f"""SELECT coalesce(c_custkey, k) AS c_custkey, c_name, p_name AS right_c_name
FROM customer FULL JOIN ({SHIFTED}) p ON c_custkey = k"""

MEDIAN_KEYS = "FROM lineitem GROUP BY l_returnflag, l_linestatus"


def fill(column: str, blank: str, window: str, limit: int | None, direction: str) -> str:
    """A filled column; `s` numbers the rows of the run in its own direction."""
    frame = f"({window} {direction} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    value = f"last_value({blank} IGNORE NULLS) OVER {frame}"
    if limit is not None:
        seen = f"max(CASE WHEN {blank} IS NOT NULL THEN s END) OVER {frame}"
        value = f"CASE WHEN s - {seen} <= {limit} THEN {value} END"
    return f"CASE WHEN {blank} IS NOT NULL THEN {column} ELSE coalesce({value}, {column}) END AS {column}"


def fill_sql(group: str, limit: int | None, direction: str) -> str:
    window = f"{group} ORDER BY event_id"
    return f"""WITH g AS ({GAPS}), n AS (SELECT *, row_number() OVER ({window} {direction}) AS s FROM g)
SELECT event_id, user_id, {fill('v', 'v', window, limit, direction)}, {fill('t', "nullif(t, '')", window, limit, direction)} FROM n"""


def filter_test(field: str, operator: str, condition: str) -> str:
    base = "(SELECT *, CASE WHEN value < 10 THEN NULL ELSE value END AS v FROM events)"
    return "\nUNION ALL\n".join(
        f"SELECT '{field}' AS field, '{operator}' AS operator, '{branch}' AS branch, count(*) AS n, "
        f"CAST(sum(event_id) AS BIGINT) AS ids FROM {base} WHERE {test}"
        for branch, test in (("true", condition), ("false", f"NOT coalesce({condition}, FALSE)")))


def summary(column: str, number: str | None, source: str, digits: int) -> str:
    values = f"min({number}) AS min, max({number}) AS max, round(avg({number}), {digits}) AS mean" if number else (
        "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean")
    return (f"SELECT '{column}' AS \"column\", count(*) AS count, count(*) - count({column}) AS nulls, {values} FROM {source}")


def gaussian(source: str, row_columns: str, features: list[str], target: str, output: str) -> str:
    stats = ", ".join(f"avg({f}) AS m{i}, greatest(var_pop({f}), 1e-9) AS v{i}" for i, f in enumerate(features))
    score = "ln(n / total)" + "".join(
        f" - 0.5 * ln(2 * pi() * v{i}) - pow({f} - m{i}, 2) / (2 * v{i})" for i, f in enumerate(features))
    return f"""WITH rows AS (SELECT row_number() OVER () AS rid, {row_columns}, {', '.join(f'{f} AS f{i}' for i, f in enumerate(features))} FROM {source}),
model AS (SELECT {target} AS class, count(*) AS n, (SELECT count(*) FROM {source}) AS total, {stats} FROM {source} GROUP BY {target}),
scored AS (SELECT rid, class, {score_over(score, features)} AS score FROM rows, model),
best AS (SELECT rid, arg_max(class, struct_pack(s := score, c := class)) AS class FROM scored GROUP BY rid)
SELECT {row_columns}, class AS {output} FROM rows JOIN best USING (rid)"""


def score_over(score: str, features: list[str]) -> str:
    for i, f in enumerate(features):
        score = score.replace(f"pow({f} - m{i}", f"pow(f{i} - m{i}")
    return score


def corr(a: str, b: str, source: str) -> str:
    both = f"({source})"
    return f"""SELECT '{a}' AS col1, '{b}' AS col2, round(CASE WHEN stddev_samp({a}) * stddev_samp({b}) > 0
THEN covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})) ELSE 0 END, 4) AS pearson
FROM {both} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"""


LINE_CORR = "SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem"
PAIR_CORR = """SELECT CASE WHEN l_quantity < 10 THEN NULL ELSE l_quantity END AS a,
CASE WHEN l_discount > 0.08 THEN NULL ELSE l_extendedprice END AS b, 3.0::DOUBLE AS c FROM lineitem"""
#: Columns of `correlation_many_columns`, in SQL that both engines read.
WIDE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_extendedprice + 1000000000", "l_quantity * l_discount",
        "CASE WHEN l_quantity > 10 THEN l_tax END", "CASE WHEN l_discount < 0.08 THEN l_extendedprice END", "CAST(3 AS DOUBLE)",
        "CAST(l_orderkey AS DOUBLE)", "CAST(l_partkey AS DOUBLE)", "CAST(l_suppkey AS DOUBLE)", "CAST(l_linenumber AS DOUBLE)",
        "l_quantity * l_quantity", "l_extendedprice / l_quantity", "CASE WHEN l_linenumber < 3 THEN l_quantity END")
WIDE_CORR = "SELECT " + ", ".join(f"{e} AS c{i:02d}" for i, e in enumerate(WIDE)) + " FROM lineitem"
TEXT_PART = """(SELECT p_name, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN p_type ELSE p_size::VARCHAR END AS t FROM part)"""
SPACES = r"^[\s\x0B\p{Z}\x{85}]+|[\s\x0B\p{Z}\x{85}]+$"

ORACLE: dict[str, str] = {
    "filter_groupby": """
SELECT o_orderpriority, round(sum(o_totalprice * 0.8), 0) AS total, count(o_orderkey) AS n, round(avg(o_totalprice), 2) AS mean,
  min(o_totalprice) AS low, max(o_totalprice) AS high, count(DISTINCT o_custkey) AS customers,
  round(stddev_samp(o_totalprice), 2) AS sd, round(var_samp(o_totalprice * 0.8), 0) AS var
FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderpriority""",
    "groupby_median": f"""SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 3) AS mid,
  median(l_quantity) AS mid_quantity {MEDIAN_KEYS}""",
    "groupby_median_ranged": f"""SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 3) AS mid, count(l_tax) AS n
  {MEDIAN_KEYS}""",
    "groupby_first_last": """SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type,
  arg_max(value, event_id) AS last_value FROM events GROUP BY user_id""",
    "groupby_empty_keys": """
WITH e AS (SELECT event_type AS kind, CASE WHEN value < 10 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS what
  FROM events WHERE event_type NOT IN ('error', 'view'))
SELECT kind, count(what) AS n, count(DISTINCT what) + CAST(max(CASE WHEN what IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS different
FROM e GROUP BY kind""",
    "aggregate": """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS SUM_l_quantity, round(avg(l_extendedprice), 2) AS AVG_l_extendedprice,
  min(l_discount) AS MIN_l_discount, max(l_tax) AS MAX_l_tax, count(*) AS COUNT_l_orderkey
FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "aggregate_text_numbers": """
WITH p AS (SELECT p_brand, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE p_size END::DOUBLE AS s FROM part)
SELECT p_brand, sum(s) AS SUM_size, min(s) AS MIN_size, max(s) AS MAX_size, count(*) AS COUNT_size FROM p GROUP BY p_brand""",
    "pivot_count": """
SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error,
  count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup,
  count(*) FILTER (event_type = 'view') AS "view" FROM events GROUP BY user_id""",
    "pivot_sum": """
SELECT l_suppkey, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0), 2) AS A,
  round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0), 2) AS N,
  round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0), 2) AS R FROM lineitem GROUP BY l_suppkey""",
    "unpivot": """
SELECT s_suppkey, 's_name' AS field, s_name AS content FROM supplier
UNION ALL SELECT s_suppkey, 's_nationkey', CAST(s_nationkey AS VARCHAR) FROM supplier""",
    "unpivot_numbers": "\nUNION ALL\n".join(
        f"SELECT l_returnflag, '{c}' AS measure, round(sum({c}), 2) AS total, count({c}) AS n FROM lineitem GROUP BY l_returnflag"
        for c in ("l_quantity", "l_discount", "l_tax")),
    "select_rename_cast": """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(trunc(o_totalprice) AS BIGINT) AS price, o_orderstatus,
  NULL::VARCHAR AS not_there FROM orders""",
    "cast_text": """
WITH p AS (SELECT p_partkey, p_size % 4 AS m, p_size, p_retailprice FROM part)
SELECT p_partkey, CASE WHEN m = 1 THEN p_size::BIGINT END AS i,
  CASE m WHEN 1 THEN p_size::DOUBLE WHEN 2 THEN p_retailprice END AS f,
  CASE WHEN m = 3 THEN TRUE WHEN m = 1 AND p_size = 1 THEN TRUE END AS b FROM p""",
    "add_column": """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * 0.5, 8) AS half, round(l_extendedprice / l_quantity, 8) AS each,
  'item' AS label, l_linenumber AS copy, round(l_quantity - l_discount, 8) AS less, round(l_quantity + l_tax, 8) AS more FROM lineitem""",
    "auto_field": """SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size, p_retailprice, p_size > 25 AS large FROM part""",
    "fillna_value": """
SELECT event_id, CASE WHEN value < 10 THEN -1.0 ELSE value END AS v,
  CASE WHEN event_type IN ('error', 'view', 'click') THEN 'none' ELSE event_type END AS t FROM events""",
    "data_cleansing": rf"""
WITH d AS (SELECT doc_id, regexp_replace(lower(regexp_replace(text, '{SPACES}', '', 'g')), '[^\p{{L}}\p{{N}}\s]', '', 'g') AS t FROM documents)
SELECT doc_id, md5(nullif(t, '')) AS digest, length(nullif(t, '')) AS chars FROM d""",
    "find_replace": r"""
WITH p AS (SELECT page_id, url, replace(url, 'http://', 'https://') AS scheme,
  regexp_replace(url, '^https?://([^/]+)/.*$', '<\1>') AS host, regexp_extract(url, '/(fr|en|de|es)/', 1) AS lang FROM pages)
SELECT page_id, url, scheme, host, CASE WHEN lang = 'fr' THEN 'french' ELSE lang END AS lang FROM p""",
    "regex_extract": r"""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, '' AS no_group,
  regexp_replace(url, '(\d+)', '<\1>', 'g') AS url FROM pages""",
    "regex_match": r"""
SELECT lang, source, count(*) AS n FROM documents WHERE regexp_matches(text, '[[:digit:]]{3}\s') GROUP BY lang, source""",
    "text_to_columns": """
SELECT p_partkey, p_name, p_brand, nullif(split_part(p_name, ' ', 1), '') AS p_name_1, nullif(split_part(p_name, ' ', 2), '') AS p_name_2,
  split_part(p_brand, '#', 1) AS b1, nullif(split_part(p_brand, '#', 2), '') AS b2, NULL::VARCHAR AS b3 FROM part""",
    "datetime_typed": """
SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS shown,
  strftime(o_orderdate + INTERVAL 10 DAY + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS later, 240::BIGINT AS hours,
  year(o_orderdate) AS year, month(o_orderdate) AS month, day(o_orderdate) AS day, dayname(o_orderdate) AS weekday,
  hour(o_orderdate) AS hour FROM orders""",
    "datetime_text": """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE
  strftime(date_trunc('minute', o_orderdate) + INTERVAL 30 HOUR, '%Y-%m-%dT%H:%M:%S') END AS d FROM orders""",
    "filter_text": """SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AND o_totalprice <= 250000""",
    "filter_advanced": "\nUNION ALL\n".join(filter_test(*t) for t in (
        ("v", "gte", "v >= 50"), ("event_type", "contains", "contains(event_type, 'i')"),
        ("event_type", "not_contains", "NOT contains(event_type, 'e')"), ("event_type", "starts_with", "starts_with(event_type, 'e')"),
        ("event_type", "ends_with", "ends_with(event_type, 'k')"), ("v", "is_null", "v IS NULL"), ("v", "is_not_null", "v IS NOT NULL"),
        ("event_type", "gt", "event_type > 'error'"), ("v", "neq", "v <> 12.31"), ("user_id", "is_true", "user_id <> 0"),
        ("v", "eq", "v = 12.31"), ("v", "lt", "v < 30"), ("v", "lte", "v <= 30"), ("user_id", "is_false", "user_id = 0"))),
    "filter_advanced_outputs": "SELECT event_id, CASE WHEN value < 20 THEN 0 ELSE 1 END AS output FROM events",
    "filter_quoted_operator": """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' OR o_orderkey % 3 <> 1 THEN 0
  WHEN o_totalprice > 100000 THEN 1 ELSE 2 END AS output FROM orders""",
    "filter_rules": """SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders
WHERE o_orderpriority > '2' AND o_orderpriority < '5' AND o_orderstatus <> 'O'""",
    "split_outputs": """SELECT event_id, CASE WHEN value > 60 THEN 0 WHEN value > 20 THEN 1 WHEN event_type = 'click' THEN 2 ELSE 3 END AS output
FROM events""",
    "route": """
SELECT CASE WHEN l_quantity > 40 THEN 0 WHEN l_discount > 0.05 THEN 1 ELSE 2 END AS _route, count(*) AS n, round(sum(l_quantity), 2) AS q
FROM lineitem GROUP BY 1""",
    "fork": "SELECT *, 'a' AS way FROM supplier UNION ALL SELECT *, 'b' FROM supplier",
    "row_counts": """SELECT 'before' AS step, count(*) AS n FROM orders
UNION ALL SELECT 'after', count(*) FROM orders WHERE o_totalprice > 250000""",
    "dedup_keys": "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem",
    "drop_duplicates_first": """SELECT event_id, user_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""",
    "drop_duplicates_last": """SELECT conv_id, turn, role FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""",
    "drop_duplicates_none": "SELECT doc_id, lang, source FROM documents QUALIFY count(*) OVER (PARTITION BY text) = 1",
    "drop_duplicates_indexed": """
WITH l AS (SELECT max(event_id) AS event_id, user_id FROM events GROUP BY user_id)
SELECT row_number() OVER (ORDER BY event_id) - 1 AS _index, event_id, user_id FROM l""",
    "sort_top": """SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber LIMIT 100""",
    "sort_text_numbers": """
WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_size > 45 THEN p_name ELSE p_size::VARCHAR END AS t FROM part)
SELECT p_partkey, t FROM p ORDER BY p_size > 45, CASE WHEN p_size <= 45 THEN p_size END, t, p_partkey LIMIT 50""",
    "row_index": "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS _index FROM orders",
    "row_index_with_ties": """
WITH n AS (SELECT l_returnflag, l_linestatus, row_number() OVER (ORDER BY l_returnflag, l_linestatus) - 1 AS i FROM lineitem)
SELECT l_returnflag, l_linestatus, min(i) AS first, max(i) AS last, count(DISTINCT i) AS n FROM n GROUP BY 1, 2""",
    "sampling_first": "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 100",
    "sampling_every": """SELECT event_id, user_id FROM events QUALIFY (row_number() OVER (ORDER BY ts, event_id) - 1) % 10 = 0""",
    "union_by_name": """
SELECT c_custkey, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment, NULL::BIGINT AS s_suppkey FROM customer
UNION ALL SELECT NULL, s_name, s_nationkey, s_acctbal, NULL, s_suppkey FROM supplier""",
    "ffill": fill_sql("", None, ""),
    "ffill_written": fill_sql("", None, ""),
    "ffill_limit_per_user": fill_sql("PARTITION BY user_id", 1, ""),
    "ffill_hot_users": fill_sql("PARTITION BY user_id", 1, ""),
    "ffill_hot_users_written": fill_sql("PARTITION BY user_id", 1, ""),
    "bfill": fill_sql("", 2, "DESC"),
    "join_inner": """SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey""",
    "join_aggregated": """SELECT n_name, round(sum(o_totalprice), 0) AS total, count(o_custkey) AS n FROM orders
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "join_left": "SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "join_right": "SELECT d.doc_id, quality, toxic, lang FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id",
    "join_full": FULL,
    "join_full_hot_sides": FULL,
    **{name: f"""SELECT coalesce(c_custkey::DOUBLE, k) AS c_custkey, c_name, p_name
FROM customer {how} JOIN (SELECT p_partkey / 2 AS k, p_name FROM part) p ON c_custkey = k"""
       for how in ("FULL", "RIGHT") for name in (f"join_{how.lower()}_mixed_keys", f"join_{how.lower()}_mixed_keys_split")},
    "join_int_keys": """SELECT coalesce(c_custkey * 1000000, o_orderkey * 1000000) AS c, c_name, o_orderstatus
FROM customer FULL JOIN orders ON c_custkey = o_orderkey""",
    "merge_inner": f"""SELECT c_custkey, c_name AS c_name_c, p_name AS c_name_p FROM customer JOIN ({SHIFTED}) p ON c_custkey = k""",
    "merge_right": f"""SELECT k AS c_custkey, c_name AS c_name_c, p_name AS c_name_p FROM customer RIGHT JOIN ({SHIFTED}) p ON c_custkey = k""",
    "map_columns": "SELECT * RENAME (s_name AS name, s_nationkey AS nation) FROM supplier",
    "text_input_lookup": """SELECT n_name, n_regionkey::VARCHAR AS r,
  CASE n_regionkey WHEN 0 THEN 'Africa' WHEN 1 THEN 'America' WHEN 2 THEN 'Asia' WHEN 3 THEN 'Europe' END AS continent FROM nation""",
    "sampling_percent": """SELECT o_orderkey, o_custkey FROM orders
WHERE ('0x' || substr(md5('1' || chr(31) || o_custkey), 1, 15))::BIGINT < 0.2 * (1::BIGINT << 60)""",
    "sampling_all_rows_small_share": """SELECT l_orderkey, l_linenumber FROM lineitem
WHERE ('0x' || substr(md5('0' || chr(31) || l_orderkey || chr(31) || l_linenumber), 1, 15))::BIGINT < 0.005 * (1::BIGINT << 60)""",
    "csv_many_headers": "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer",
    "csv_letters": "SELECT s_suppkey::VARCHAR AS A, s_name AS B FROM supplier",
    "csv_preview_all": "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation",
    "apply_changes_strict": CHANGED,
    "sort_all": """SELECT l_orderkey, l_linenumber,
  row_number() OVER (ORDER BY l_shipdate DESC, l_quantity, l_orderkey, l_linenumber) - 1 AS i FROM lineitem""",
    "join_null_keys": """SELECT CASE WHEN n_regionkey = 1 THEN NULL ELSE n_regionkey END AS k, n_name, r_name
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""",
    "merge_outer": f"""SELECT coalesce(c_custkey, k) AS c_custkey, c_name AS c_name_c, p_name AS c_name_p
FROM customer FULL JOIN ({SHIFTED}) p ON c_custkey = k""",
    "merge_validated": """SELECT o_orderkey, o_custkey AS key, o_totalprice AS amount_x, c_acctbal AS amount_y, c_name
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "append_fields": """
WITH c AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer),
s AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier)
SELECT c_custkey, c_acctbal, s_suppkey, s_name FROM c LEFT JOIN s USING (i)""",
    "field_summary": "\nUNION ALL\n".join(summary(c, n, "lineitem", 2) for c, n in (
        ("l_orderkey", "l_orderkey::DOUBLE"), ("l_quantity", "l_quantity"), ("l_extendedprice", "l_extendedprice"),
        ("l_returnflag", None), ("l_shipdate", None))),
    "field_summary_text": "\nUNION ALL\n".join(
        summary(c, n, TEXT_PART, 4) for c, n in (("t", "try_cast(t AS DOUBLE)"), ("p_name", None))),
    "frequency_table": """
SELECT l_linenumber AS value, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM lineitem), 2)::DOUBLE AS percent
FROM lineitem GROUP BY 1""",
    "correlation": "\nUNION ALL\n".join(corr(a, b, LINE_CORR) for a, b in (
        ("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"),
        ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax"))),
    "correlation_pairwise": "\nUNION ALL\n".join(corr(a, b, PAIR_CORR) for a, b in (("a", "b"), ("a", "c"), ("b", "c"))),
    "regression": """
WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i,
  regr_r2(l_extendedprice, l_quantity) AS r FROM lineitem)
SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, round(s * l_quantity + i, 2) AS predicted, round(s, 4) AS slope,
  round(i, 2) AS intercept, round(r, 4) AS r2 FROM lineitem, m""",
    "naive_bayes": gaussian("lineitem", "l_orderkey, l_partkey, l_linenumber, l_returnflag",
                            ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_returnflag", "predicted_class"),
    "naive_bayes_many_classes": gaussian("events", "event_id, user_id", ["value"], "user_id", "likely_user"),
    "apply_changes": CHANGED,
    "stream_changes": CHANGED,
    "upsert": f"""
WITH snap AS ({SNAPSHOT}) SELECT * FROM snap WHERE id NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT s_suppkey, 'SUPPLIER', s_acctbal FROM supplier""",
    "json_records": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "json_pages": """
WITH p AS (SELECT *, floor(event_id / 500) AS page, count(*) OVER (PARTITION BY floor(event_id / 500)) AS n FROM events)
SELECT event_id, user_id, event_type FROM p WHERE page <= coalesce((SELECT min(page) FROM p WHERE n < 500), 9e18)""",
    "csv_round_trip": r"""SELECT regexp_replace(CAST(c_acctbal AS VARCHAR), '\.0$', '') AS c_acctbal, CAST(c_custkey AS VARCHAR) AS c_custkey,
  c_mktsegment, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer""",
    "csv_quoted_text": "SELECT doc_id, md5(text) AS digest, lang FROM documents",
    "csv_scan": "\nUNION ALL\n".join(
        f"SELECT (SELECT string_agg(column_name, ' ' ORDER BY column_name) FROM (DESCRIBE {t})) AS columns, 'utf-8' AS encoding, "
        f"'{d}' AS delimiter, 'auto' AS newline, TRUE AS has_header, (SELECT count(*) FROM (DESCRIBE {t})) AS width, 'high' AS confidence"
        for t, d in (("orders", ";"), ("part", "|"), ("supplier", "\t"), ("customer", ","))),
    "browse": """
WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000)
SELECT CAST(to_json(o) AS VARCHAR) AS json FROM o""",
    "stream_steps": """
SELECT o_orderkey, round(o_totalprice - 1000, 2) AS net, year(o_orderdate) AS year,
  CASE WHEN o_totalprice - 1000 > 300000 THEN 0 ELSE 1 END AS _route FROM orders WHERE o_totalprice > 100000""",
    "stream_first_per_key": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_lookup": """SELECT l_orderkey, l_linenumber, l_partkey, p_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
    "change_store": CHANGED,
    "change_store_streams": CHANGED,
    "groupby_medians_ranged": f"""SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 3) AS mid,
  round(median(l_discount), 3) AS mid_discount, round(sum(l_quantity), 3) AS total {MEDIAN_KEYS}""",
    "sort_text_numbers_all": """
WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_size > 45 THEN p_name ELSE p_size::VARCHAR END AS t FROM part)
SELECT p_partkey, t, row_number() OVER (ORDER BY p_size > 45, CASE WHEN p_size <= 45 THEN p_size END, t, p_partkey) - 1 AS i FROM p""",
    "correlation_many_columns": "\nUNION ALL\n".join(
        corr(f"c{i:02d}", f"c{j:02d}", WIDE_CORR) for i in range(len(WIDE)) for j in range(i + 1, len(WIDE))),
    "join_large_keys": """
SELECT o_orderkey + 9007199254740992 AS k, o_custkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = 2 * l_orderkey""",
    "json_strict_types": "SELECT event_id, CASE WHEN event_id % 3 != 0 THEN user_id END AS k, event_type AS t FROM events",
    "data_grid_lookup": """
SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'X' THEN 'unused' END AS meaning FROM orders""",
    "preview_steps": """
SELECT * FROM (SELECT o_orderkey, o_totalprice, 'sorted' AS step FROM orders ORDER BY o_orderkey LIMIT 5)
UNION ALL SELECT * FROM (SELECT o_orderkey, o_totalprice, 'filtered' FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000)
  WHERE o_totalprice > 100000 ORDER BY o_orderkey LIMIT 5)""",
    "auto_field_mixed": """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'bigint' WHEN 1 THEN 'double' WHEN 2 THEN 'boolean' ELSE 'string' END AS kind,
  CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS BIGINT) WHEN 1 THEN CAST(trunc(p_retailprice) AS BIGINT) WHEN 2 THEN 1 END AS whole,
  CASE WHEN p_partkey % 4 = 3 THEN p_name END AS words FROM part""",
    "sketches_merged": "SELECT DISTINCT event_type, TRUE AS users_near, TRUE AS mid_near FROM events",
}
