"""One query per operator over the tables, each with the SQL that an independent engine checks it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks import fixtures
from siltworks.operators import asof, changes, duplicates, fitted, formats, missing, normalise, outliers, prepare, profile, sketches
from siltworks.plans.pipeline import Pipeline
from siltworks.sources import files, session
from siltworks.sources.scratch import scratch_path
from siltworks.streaming import clean
from siltworks.streaming import duplicates as stream_duplicates

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# The dirty variants of siltworks.fixtures in SQL.
EV = """ev AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type,
  CASE WHEN event_id % 7 <> 0 THEN value END AS value, props FROM events)"""
LI = """li AS (SELECT * REPLACE (CASE WHEN l_linenumber <> 3 THEN l_tax END AS l_tax, CASE WHEN l_partkey % 5 <> 0 THEN l_returnflag END AS l_returnflag) FROM lineitem)"""
CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
MARKED = """CASE o_orderkey % 10 WHEN 0 THEN ' NA ' WHEN 1 THEN 'null' WHEN 2 THEN '' ELSE o_orderstatus END"""
LINEITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
EVENTS = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}
ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in names})


def each(names, one: str) -> str:
    return " UNION ALL ".join(one.replace("{c}", c) for c in names)


# Completeness


@query("completeness_mean", f"WITH {LI} SELECT round(({' + '.join(f'count({c})' for c in LINEITEM)}) * 100.0 / (count(*) * {len(LINEITEM)}), 6) AS mean_pct FROM li")
def completeness_mean(spark, sf_dir):
    return rounded(profile.completeness_mean(fixtures.lineitem_gaps(spark, sf_dir)), "mean_pct")


@query("completeness_by_column", f"WITH {LI} " + each(LINEITEM, "SELECT '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_present, round(100.0 * count({c}) / count(*), 6) AS pct FROM li"))
def completeness_by_column(spark, sf_dir):
    return rounded(profile.completeness_by_column(fixtures.lineitem_gaps(spark, sf_dir)), "pct")


_ROW_PCT = "round((" + " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in EVENTS) + ") * 100.0 / 6, 2)"


def _page_sql(order: str, page: int) -> str:
    return f"""WITH {EV}, r AS (SELECT event_id AS row_key, {_ROW_PCT} AS pct FROM ev),
      n AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rn, count(*) OVER () AS total FROM r)
      SELECT row_key, pct FROM n WHERE (rn - 1) // 1000 = least({page}, (total - 1) // 1000)"""


@query("completeness_by_row_page", _page_sql("pct DESC, row_key", 1))
def completeness_by_row_page(spark, sf_dir):
    return profile.completeness_by_row(fixtures.events_gaps(spark, sf_dir), "event_id", order="desc", page=1)


@query("completeness_by_row_asc", _page_sql("pct, row_key", 0))
def completeness_by_row_asc(spark, sf_dir):
    return profile.completeness_by_row(fixtures.events_gaps(spark, sf_dir), "event_id", order="asc")


@query("completeness_by_row_raw", _page_sql("row_key", 10**6))
def completeness_by_row_raw(spark, sf_dir):
    return profile.completeness_by_row(fixtures.events_gaps(spark, sf_dir), "event_id", order="key", page=10**6)


@query(
    "missing_analysis",
    f"WITH {EV} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS dtype, count(*) - count({c}) AS missing_count, round((count(*) - count({c})) * 100.0 / greatest(count(*), 1), 2) AS missing_ratio, count({c}) AS non_missing_count, count(DISTINCT {c}) AS unique_count FROM ev"
        for c, t in EVENTS.items()
    ),
)
def missing_analysis(spark, sf_dir):
    return profile.missing_analysis(fixtures.events_gaps(spark, sf_dir))


# Frequencies


@query("distinct_by_column", f"WITH {EV} " + each(EVENTS, "SELECT '{c}' AS column_name, count(DISTINCT {c}) + CAST(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_distinct, round((count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)) * 100.0 / count(*), 2) AS pct FROM ev"))
def distinct_by_column(spark, sf_dir):
    return profile.distinct_by_column(fixtures.events_gaps(spark, sf_dir))


def _top_sql(table: str, c: str, least: int, k: int = 50, cte: str = "") -> str:
    return f"""{cte} SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM {table}), 2) AS pct
      FROM {table} GROUP BY {c} HAVING count(*) >= {least} ORDER BY n DESC, value NULLS FIRST LIMIT {k}"""


@query("top_values", _top_sql("ev", "event_type", 1, cte=f"WITH {EV}"))
def top_values(spark, sf_dir):
    return profile.top_values(fixtures.events_gaps(spark, sf_dir), "event_type")


@query("duplicate_top_values", _top_sql("events", "user_id", 2))
def duplicate_top_values(spark, sf_dir):
    return profile.duplicate_top_values(fixtures.load(spark, sf_dir, "events"), "user_id")


@query("duplicate_metrics", each(ORDERS, "SELECT '{c}' AS column_name, count_if(n >= 2)::BIGINT AS n_values, coalesce(sum(CASE WHEN n >= 2 THEN n END), 0)::BIGINT AS n_rows, round(coalesce(sum(CASE WHEN n >= 2 THEN n END), 0) * 100.0 / sum(n), 2) AS pct FROM (SELECT {c}, count(*) AS n FROM orders GROUP BY {c})"))
def duplicate_metrics(spark, sf_dir):
    return profile.duplicate_metrics(fixtures.load(spark, sf_dir, "orders"))


@query("duplicate_key_rows", f"WITH {EV} SELECT * FROM ev QUALIFY count(*) OVER (PARTITION BY user_id, event_type) > 1 ORDER BY event_id LIMIT 100")
def duplicate_key_rows(spark, sf_dir):
    return profile.duplicate_rows(fixtures.events_gaps(spark, sf_dir), ["user_id", "event_type"], order_by=["event_id"])


@query("duplicate_key_groups", f"WITH {EV} SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) > 1")
def duplicate_key_groups(spark, sf_dir):
    return profile.duplicate_key_groups(fixtures.events_gaps(spark, sf_dir), ["user_id", "event_type"])


def _histogram_sql(table: str, c: str, bins: int, cte: str = "") -> str:
    head = f"WITH {cte + ', ' if cte else ''}"
    return f"""{head} e AS (SELECT min({c}) AS lo, max({c}) AS hi FROM {table}), b AS (
      SELECT CAST(least(floor(({c} - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INTEGER) AS bucket, lo, (hi - lo) / {bins} AS w FROM {table}, e WHERE {c} IS NOT NULL)
      SELECT bucket, round(bucket * w + lo, 6) AS x, count(*) AS n FROM b GROUP BY bucket, w, lo"""


@query("histogram_numeric", _histogram_sql("ev", "value", 30, EV))
def histogram_numeric(spark, sf_dir):
    return rounded(profile.histogram(fixtures.events_gaps(spark, sf_dir), "value"), "x")


@query("histogram_bigint", _histogram_sql("events", "CAST(user_id AS DOUBLE)", 50))
def histogram_bigint(spark, sf_dir):
    return rounded(profile.histogram(fixtures.load(spark, sf_dir, "events"), "user_id", bins=50), "x")


@query("histogram_constant", "SELECT 0 AS bucket, 5.0::DOUBLE AS x, count(*) AS n FROM orders")
def histogram_constant(spark, sf_dir):
    return profile.histogram(fixtures.load(spark, sf_dir, "orders").select(F.lit(5).alias("five")), "five")


@query("distribution_topk_other", """WITH c AS (SELECT CAST(l_shipdate AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rn, count(*) OVER () AS bars FROM c)
  SELECT value, n FROM r WHERE bars <= 2000 OR rn <= 50 UNION ALL SELECT 'Autres', CAST(sum(n) AS BIGINT) FROM r WHERE bars > 2000 AND rn > 50 HAVING sum(n) > 0""")
def distribution_topk_other(spark, sf_dir):
    return profile.distribution(fixtures.load(spark, sf_dir, "lineitem"), "l_shipdate")


@query("distribution_few", f"WITH {EV} SELECT event_type AS value, count(*) AS n FROM ev GROUP BY 1")
def distribution_few(spark, sf_dir):
    return profile.distribution(fixtures.events_gaps(spark, sf_dir), "event_type")


@query("distributions_selected", each(("o_orderstatus", "o_orderpriority"), "SELECT '{c}' AS column_name, {c} AS label, count(*) AS n FROM orders GROUP BY {c}"))
def distributions_selected(spark, sf_dir):
    return profile.distributions(fixtures.load(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("missing_preview", f"WITH {EV} SELECT coalesce(event_type, '<NA>') AS label, count(*) AS n FROM ev GROUP BY 1")
def missing_preview(spark, sf_dir):
    return profile.missing_preview(fixtures.events_gaps(spark, sf_dir), "event_type")


# Outlier statistics

_BOUNDS = {
    "iqr": "b AS (SELECT CASE WHEN q3 > q1 THEN q1 - 1.5 * (q3 - q1) END AS lo, CASE WHEN q3 > q1 THEN q3 + 1.5 * (q3 - q1) END AS hi FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t}))",
    "z": "b AS (SELECT CASE WHEN s > 0 THEN m - 3.0 * s END AS lo, CASE WHEN s > 0 THEN m + 3.0 * s END AS hi FROM (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM {t}))",
    "mad": "m AS (SELECT median({c}) AS md FROM {t}), b AS (SELECT CASE WHEN s > 0 THEN md - 3.5 * s END AS lo, CASE WHEN s > 0 THEN md + 3.5 * s END AS hi FROM (SELECT md, median(abs({c} - md)) * 1.4826 AS s FROM {t}, m GROUP BY md))",
}


def bounds_sql(method: str, table: str, c: str) -> str:
    return _BOUNDS[method].replace("{c}", c).replace("{t}", table)


def _per_column(method: str, select: str) -> str:
    number = lambda c: f"CAST({c} AS DOUBLE)"
    return " UNION ALL ".join(f"(WITH {EV}, {bounds_sql(method, 'ev', number(c))} {select.replace('{c}', c).replace('{v}', number(c))})" for c in ("event_id", "user_id", "value"))


def _overview(method: str) -> None:
    @query(f"outlier_overview_{method}", _per_column(method, "SELECT '{c}' AS column_name, CAST(count_if({v} < lo OR {v} > hi) AS BIGINT) AS n_outliers, round(count_if({v} < lo OR {v} > hi) * 100.0 / count({c}), 2) AS pct FROM ev, b"))
    def overview(spark, sf_dir):
        return outliers.outlier_overview(fixtures.events_gaps(spark, sf_dir), method=method)

    @query(f"outlier_bounds_{method}", _per_column(method, "SELECT '{c}' AS column_name, round(lo, 6) AS low, round(hi, 6) AS high FROM b"))
    def bounds(spark, sf_dir):
        return rounded(outliers.outlier_bounds(fixtures.events_gaps(spark, sf_dir), method=method), "low", "high")


for _method in outliers.METHODS:
    _overview(_method)


@query("boxplot_stats", f"WITH {EV} SELECT round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS max FROM ev")
def boxplot_stats(spark, sf_dir):
    return rounded(outliers.boxplot_stats(fixtures.events_gaps(spark, sf_dir), "value"), "min", "q1", "median", "q3", "max")


@query("sample_numeric", "SELECT value FROM events WHERE value IS NOT NULL ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), value LIMIT 5000")
def sample_numeric(spark, sf_dir):
    return outliers.sample_numeric(fixtures.load(spark, sf_dir, "events"), "value", key="event_id")


# Markers, preview, sources


@query("normalize_markers", f"SELECT o_orderkey, CASE WHEN lower(trim({MARKED})) IN ('', 'na', 'n/a', 'nan', 'null', 'none') THEN NULL ELSE {MARKED} END AS status_txt, o_orderpriority FROM orders")
def normalize_markers(spark, sf_dir):
    return normalise.normalize_markers(fixtures.orders_markers(spark, sf_dir))


@query("marker_counts", "SELECT 'status_txt' AS column_name, CAST(count_if(o_orderkey % 10 < 3) AS BIGINT) AS replaced FROM orders UNION ALL SELECT 'o_orderpriority', 0")
def marker_counts(spark, sf_dir):
    return normalise.marker_counts(fixtures.orders_markers(spark, sf_dir))


@query("preview_truncated", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '…' ELSE text END AS text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents ORDER BY documents.doc_id LIMIT 10")
def preview_truncated(spark, sf_dir):
    return normalise.preview(fixtures.load(spark, sf_dir, "documents").orderBy("doc_id"))


@query("csv_roundtrip", "SELECT * FROM orders")
def csv_roundtrip(spark, sf_dir):
    orders, path = fixtures.load(spark, sf_dir, "orders"), scratch_path(spark, "orders")
    files.write_dataset(orders, path, "csv")
    return files.read_dataset(spark, path, "csv", schema=orders.schema)


@query("json_roundtrip", "SELECT * FROM customer")
def json_roundtrip(spark, sf_dir):
    customer, path = fixtures.load(spark, sf_dir, "customer"), scratch_path(spark, "customer")
    files.write_dataset(customer, path, "json")
    return files.read_dataset(spark, path, "json", schema=customer.schema)


@query("parquet_roundtrip", "SELECT * FROM supplier")
def parquet_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "supplier")
    files.write_dataset(fixtures.load(spark, sf_dir, "supplier"), path)
    return files.read_dataset(spark, path, "parquet")


@query("json_flatten", "SELECT event_id, event_type AS \"e.type\", CAST(json_extract(props, '$.k') AS INTEGER) AS \"e.props.k\" FROM events")
def json_flatten(spark, sf_dir):
    e = fixtures.load(spark, sf_dir, "events")
    nested = e.select("event_id", F.struct(F.col("event_type").alias("type"), F.from_json("props", "k int").alias("props")).alias("e"))
    return normalise.flatten(nested)


# Formats


@query("format_to_numeric", f"SELECT o_orderkey, {CENTS} / 100.0::DOUBLE AS price_txt FROM orders")
def format_to_numeric(spark, sf_dir):
    return formats.apply_formats(fixtures.orders_text(spark, sf_dir), [{"column": "price_txt", "action": "to_numeric"}], on_error="null").select("o_orderkey", "price_txt")


@query("format_to_integer", "SELECT o_orderkey, o_orderkey AS key_txt FROM orders")
def format_to_integer(spark, sf_dir):
    return formats.apply_formats(fixtures.orders_text(spark, sf_dir), [{"column": "key_txt", "action": "to_integer"}]).select("o_orderkey", "key_txt")


@query("format_to_string", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM orders")
def format_to_string(spark, sf_dir):
    return formats.apply_formats(fixtures.load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), [{"column": "o_orderkey", "action": "to_string"}])


@query("format_to_date", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date_txt FROM orders")
def format_to_date(spark, sf_dir):
    dated = formats.apply_formats(fixtures.orders_text(spark, sf_dir), [{"column": "date_txt", "action": "to_date"}], on_error="null")
    # As text, since engines hand dates over in different types.
    return dated.select("o_orderkey", F.date_format("date_txt", "yyyy-MM-dd").alias("date_txt"))


def _dated(spark, sf_dir) -> DataFrame:
    """Order dates as texts of seven shapes by key, with the month first where slashes part them, and the day first where dashes do."""
    o, d = fixtures.load(spark, sf_dir, "orders"), F.col("o_orderdate")
    shapes = ("yyyy-MM-dd", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy-MM-dd HH:mm:ss", "d MMM yyyy", "MMMM d, yyyy", "yyyyMMdd")
    text = F.coalesce(*[F.when(F.col("o_orderkey") % len(shapes) == i, F.date_format(d, f)) for i, f in enumerate(shapes)])
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.lit("\t "), text, F.lit(" "))).when(F.col("o_orderkey") % 51 != 0, text).alias("date_txt"))


@query("format_to_date_inferred", "SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 OR o_orderkey % 51 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date_txt FROM orders")
def format_to_date_inferred(spark, sf_dir):
    """Dates in mixed forms; all values with slashes, and all with dashes, tell the order of day and month."""
    dated = formats.apply_formats(_dated(spark, sf_dir), [{"column": "date_txt", "action": "to_date"}], date_formats="infer")
    return dated.select("o_orderkey", F.date_format("date_txt", "yyyy-MM-dd").alias("date_txt"))


@query("format_examples", """WITH t AS (SELECT 'o_orderpriority' AS column_name, 'to_numeric' AS action, o_orderpriority AS value FROM orders UNION ALL SELECT 'o_orderstatus', 'to_date', o_orderstatus FROM orders)
  SELECT * FROM (SELECT column_name, action, value, count(*) AS n FROM t GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY column_name, action ORDER BY value) <= 3""")
def format_examples(spark, sf_dir):
    rules = [{"column": "o_orderpriority", "action": "to_numeric"}, {"column": "o_orderstatus", "action": "to_date"}]
    return formats.format_examples(fixtures.load(spark, sf_dir, "orders"), rules, limit=3)


@query("format_to_boolean", "SELECT doc_id, quality = 1 AS flag_txt FROM labels")
def format_to_boolean(spark, sf_dir):
    return formats.apply_formats(fixtures.labels_text(spark, sf_dir), [{"column": "flag_txt", "action": "to_boolean"}])


# Missing values


def _missing(name: str, column: str, sql: str, **rule) -> None:
    others = ", ".join(c for c in EVENTS if c != column)

    @query(f"missing_{name}", f"WITH {EV} SELECT {others}, {sql} AS {column} FROM ev" if sql else f"WITH {EV} SELECT * FROM ev WHERE {column} IS NOT NULL")
    def treat(spark, sf_dir):
        out = missing.apply_missing(fixtures.events_gaps(spark, sf_dir), [{"column": column, "action": name, **rule}], order_by="event_id", on_error="null")
        return rounded(out, "value") if column == "value" and sql else out


_missing("drop_rows", "value", "")
_missing("mean", "value", "round(coalesce(value, (SELECT avg(value) FROM ev)), 6)")
_missing("median", "value", "round(coalesce(value, (SELECT median(value) FROM ev)), 6)")
_missing("mode", "event_type", "coalesce(event_type, (SELECT event_type FROM ev WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1))")
_missing("constant", "event_type", "coalesce(event_type, 'unknown')", value="unknown")
_missing("ffill", "value", "round(last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6)")
_missing("bfill", "value", "round(first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6)")
_missing("zero", "value", "round(coalesce(value, 0), 6)")
_missing("empty", "event_type", "coalesce(event_type, '')")


@query("missing_ffill_partitioned", f"WITH {EV} SELECT event_id, ts, user_id, event_type, props, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM ev")
def missing_ffill_partitioned(spark, sf_dir):
    return missing.apply_missing(fixtures.events_gaps(spark, sf_dir), [{"column": "value", "action": "ffill"}], order_by="event_id", partition_by=["user_id"])


def _line_sql(known: str, where: str, key: str, order: str, x: str, cte: str) -> str:
    """Values on the line between the last and the next known one, by window frames both ways."""
    over = f"{'PARTITION BY ' + key if key else ''} ORDER BY {order}"
    return f"""WITH {cte}, s AS (SELECT *, {known} AS k, {x} AS x FROM ev0), n AS (
      SELECT *, last_value(k IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN k IS NOT NULL THEN x END IGNORE NULLS) OVER p AS px,
        first_value(k IGNORE NULLS) OVER f AS nv, first_value(CASE WHEN k IS NOT NULL THEN x END IGNORE NULLS) OVER f AS nx
      FROM s WINDOW p AS ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
      SELECT event_id, ts, user_id, event_type, props,
        round(CASE WHEN NOT ({where}) THEN value WHEN nx = px THEN pv ELSE pv + (nv - pv) * ((x - px)::DOUBLE / (nx - px)) END, 6) AS value FROM n"""


@query("missing_interpolate", _line_sql("value", "value IS NULL", "", "event_id", "event_id", f"{EV}, ev0 AS (SELECT * FROM ev)"))
def missing_interpolate(spark, sf_dir):
    return rounded(missing.apply_missing(fixtures.events_gaps(spark, sf_dir), [{"column": "value", "action": "interpolate"}], order_by="event_id"), "value")


@query("missing_interpolate_partitioned", _line_sql("value", "value IS NULL", "user_id", "ts, event_id", "epoch_us(ts)", f"{EV}, ev0 AS (SELECT * FROM ev)"))
def missing_interpolate_partitioned(spark, sf_dir):
    """Over time, for each user."""
    return rounded(missing.apply_missing(fixtures.events_gaps(spark, sf_dir), [{"column": "value", "action": "interpolate"}], order_by=["ts", "event_id"], partition_by=["user_id"]), "value")


@query("missing_counts", f"WITH {EV} " + each(EVENTS, "SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing FROM ev"))
def missing_counts(spark, sf_dir):
    return missing.missing_counts(fixtures.events_gaps(spark, sf_dir))


# Duplicates


@query("dedup_first", f"WITH {EV} SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def dedup_first(spark, sf_dir):
    return duplicates.apply_duplicates(fixtures.events_gaps(spark, sf_dir), [{"columns": ["user_id", "event_type"], "action": "first"}], order_by="event_id")


@query("dedup_last", f"WITH {EV} SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def dedup_last(spark, sf_dir):
    return duplicates.apply_duplicates(fixtures.events_gaps(spark, sf_dir), [{"columns": ["user_id", "event_type"], "action": "last"}], order_by="event_id")


@query("dedup_none", "SELECT * FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) = 1")
def dedup_none(spark, sf_dir):
    return duplicates.apply_duplicates(fixtures.load(spark, sf_dir, "orders"), [{"columns": ["o_custkey"], "action": "none"}])


# Outlier treatment

_OUT = "(value < lo OR value > hi)"


def _treat(name: str, method: str, action: str, select: str, **rule) -> None:
    @query(f"outlier_{name}", f"WITH {EV}, {bounds_sql(method, 'ev', 'value')} {select}")
    def treat(spark, sf_dir):
        out = outliers.apply_outliers(fixtures.events_gaps(spark, sf_dir), [{"column": "value", "method": method, "action": action, **rule}])
        return rounded(out, "value")


_KEPT = "event_id, ts, user_id, event_type, props"
for _method in outliers.METHODS:
    _end = "" if _method == "iqr" else f"_{_method}"
    _treat(f"drop{_end}", _method, "drop", f"SELECT {_KEPT}, round(value, 6) AS value FROM ev, b WHERE NOT coalesce({_OUT}, false)")
    _treat(f"flag{_end}", _method, "flag", f"SELECT {_KEPT}, round(value, 6) AS value, CASE WHEN {_OUT} THEN 1 ELSE 0 END AS is_outlier_value FROM ev, b")
    _treat(f"cap{_end}", _method, "cap", f"SELECT {_KEPT}, round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 6) AS value FROM ev, b")
_treat("median", "iqr", "median", f"SELECT {_KEPT}, round(CASE WHEN {_OUT} THEN (SELECT median(value) FROM ev) ELSE value END, 6) AS value FROM ev, b")
_treat("mean", "iqr", "mean", f"SELECT {_KEPT}, round(CASE WHEN {_OUT} THEN (SELECT avg(value) FROM ev) ELSE value END, 6) AS value FROM ev, b")
_treat("constant", "iqr", "constant", f"SELECT {_KEPT}, round(CASE WHEN {_OUT} THEN -1.5 ELSE value END, 6) AS value FROM ev, b", constant="-1,5")
_treat("custom_cap", "iqr", "custom_cap", f"SELECT {_KEPT}, round(CASE WHEN lo IS NULL THEN value WHEN value < 10 THEN 10 WHEN value > 200 THEN 200 ELSE value END, 6) AS value FROM ev, b", lower_bound=10, upper_bound=200)


@query(
    "outlier_interpolate",
    _line_sql("CASE WHEN value < lo OR value > hi THEN NULL ELSE value END", "coalesce(value < lo OR value > hi, false)", "", "event_id", "event_id", f"{EV}, {bounds_sql('iqr', 'ev', 'value')}, ev0 AS (SELECT * FROM ev, b)"),
)
def outlier_interpolate(spark, sf_dir):
    rule = {"column": "value", "method": "iqr", "action": "interpolate"}
    return rounded(outliers.apply_outliers(fixtures.events_gaps(spark, sf_dir), [rule], order_by="event_id"), "value")


_TEN = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey")


def _chain_sql() -> str:
    """A MAD rule per column, each by its own column's median and spread."""
    stats = ", ".join(f"m_{c} AS (SELECT median({c}::DOUBLE) AS m FROM lineitem), b_{c} AS (SELECT m, median(abs({c}::DOUBLE - m)) * 1.4826 * 1.2 AS s FROM lineitem, m_{c} GROUP BY m)" for c in _TEN)
    capped = ", ".join(f"round(CASE WHEN s_{c} > 0 THEN greatest(least({c}::DOUBLE, m_{c} + s_{c}), m_{c} - s_{c}) ELSE {c}::DOUBLE END, 6) AS {c}" for c in _TEN)
    ends = ", ".join(f"b_{c}.m AS m_{c}, b_{c}.s AS s_{c}" for c in _TEN)
    return f"WITH {stats}, e AS (SELECT {ends} FROM {', '.join(f'b_{c}' for c in _TEN)}) SELECT l_orderkey, l_linenumber, {capped} FROM lineitem, e"


@query("outlier_chain_mad", _chain_sql())
def outlier_chain_mad(spark, sf_dir):
    """A rule for each of six columns, whose statistics share their passes."""
    rules = [{"column": c, "method": "mad", "action": "cap", "mad_threshold": 1.2} for c in _TEN]
    return rounded(outliers.apply_outliers(fixtures.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_TEN), rules), *_TEN)


# Pipelines

FULL = (
    Pipeline()
    .with_step("formats", [{"column": "user_id", "action": "to_string"}])
    .with_step("missing_values", [{"column": "value", "action": "median"}, {"column": "event_type", "action": "constant", "value": "unknown"}])
    .with_step("duplicates", [{"columns": ["user_id", "event_type"], "action": "first"}])
    .with_step("outliers", [{"column": "value", "method": "iqr", "action": "cap", "iqr_k": 1.5}])
)


@query(
    "pipeline_full",
    f"""WITH {EV}, f AS (SELECT * REPLACE (CAST(user_id AS VARCHAR) AS user_id, coalesce(value, (SELECT median(value) FROM ev)) AS value, coalesce(event_type, 'unknown') AS event_type) FROM ev),
      d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1), {bounds_sql("iqr", "d", "value")}
      SELECT {_KEPT}, round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 6) AS value FROM d, b""",
)
def pipeline_full(spark, sf_dir):
    return rounded(FULL.apply(fixtures.events_gaps(spark, sf_dir), order_by="event_id", on_error="null"), "value")


@query(
    "pipeline_history",
    f"""WITH {EV}, n AS (SELECT count(*) AS n, count(*) - count(event_type) AS t, count(*) - count(value) AS v FROM ev), d AS (SELECT count(*) AS n FROM (SELECT DISTINCT user_id, coalesce(event_type, 'unknown') FROM ev)), r AS (
        SELECT 1 AS step_no, n AS n_rows, t + v AS n_missing FROM n UNION ALL SELECT 2, n, 0 FROM n UNION ALL SELECT 3, n, 0 FROM d UNION ALL SELECT 4, n, 0 FROM d)
      SELECT t.*, n_rows, n_missing FROM (VALUES (1, 'formats', 'user_id', 'to_string', ''), (2, 'missing_values', 'value', 'median', ''), (2, 'missing_values', 'event_type', 'constant', '{{"value": "unknown"}}'),
      (3, 'duplicates', 'user_id, event_type', 'first', ''), (4, 'outliers', 'value', 'cap', '{{"iqr_k": 1.5, "method": "iqr"}}')) t(step_no, step, target, action, parameters) JOIN r USING (step_no)""",
)
def pipeline_history(spark, sf_dir):
    """Each rule of a stored pipeline with the rows and missing cells that its step left."""
    p = Pipeline.from_json(FULL.to_json())
    counts = p.trace(fixtures.events_gaps(spark, sf_dir), order_by="event_id", on_error="null").drop("step")
    return p.describe(spark).join(counts, "step_no")


# Preparation

_TYPES_SQL = "SELECT list(DISTINCT event_type ORDER BY event_type) AS v FROM events"


@query("encode_ordinal", f"WITH t AS ({_TYPES_SQL}) SELECT event_id, CAST(list_position(v, event_type) - 1 AS INTEGER) AS event_type FROM events, t")
def encode_ordinal(spark, sf_dir):
    return prepare.ordinal(fixtures.load(spark, sf_dir, "events").select("event_id", "event_type"), "event_type")


@query("encode_onehot", "SELECT o_orderkey, " + ", ".join(f"CASE WHEN o_orderstatus = '{s}' THEN 1 ELSE 0 END AS \"o_orderstatus_{s}\"" for s in "FOP") + " FROM orders")
def encode_onehot(spark, sf_dir):
    return prepare.one_hot(fixtures.load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", values=["F", "O", "P"])


_PART = ("p_size", "p_retailprice")


def _scale(name: str, operator, center: str, spread: str) -> None:
    stats = ", ".join(f"{x.replace('{c}', c)} AS {k}_{c}" for c in _PART for k, x in (("c", center), ("s", spread)))
    values = ", ".join(f"round((CAST({c} AS DOUBLE) - c_{c}) / s_{c}, 6) AS {c}" for c in _PART)

    @query(f"scale_{name}", f"WITH s AS (SELECT {stats} FROM part) SELECT p_partkey, {values} FROM part, s")
    def scale(spark, sf_dir):
        return rounded(operator(fixtures.load(spark, sf_dir, "part").select("p_partkey", *_PART), list(_PART)), *_PART)


_scale("standard", prepare.scale_standard, "avg({c})", "stddev_pop({c})")
_scale("minmax", prepare.scale_minmax, "min({c})", "max({c}) - min({c})")
_scale("robust", prepare.scale_robust, "median({c})", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)")


@query("normalize_l2", "SELECT p_partkey, round(p_size / sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) AS p_size, round(p_retailprice / sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) AS p_retailprice FROM part")
def normalize_l2(spark, sf_dir):
    return rounded(prepare.normalize_l2(fixtures.load(spark, sf_dir, "part").select("p_partkey", *_PART), list(_PART)), *_PART)


_PCA = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_COV = "[" + ", ".join("[" + ", ".join(f"covar_pop({a}, {b})" for b in _PCA) + "]" for a in _PCA) + "]"
_TIMES = "list_transform(m, lambda r: list_dot_product(r, v))"


def _power_sql(name: str, start: str) -> str:
    """A hundred steps of power iteration from a matrix ``m``; the last row has the eigenvector, its largest weight positive."""
    return f"""{name}(step, m, v) AS (
      SELECT 0, m, [0.5::DOUBLE, 0.5, 0.5, 0.5] FROM ({start})
      UNION ALL SELECT step + 1, m, list_transform({_TIMES}, lambda x: x / sqrt(list_dot_product({_TIMES}, {_TIMES}))) FROM {name} WHERE step < 100
    ), {name}_end AS (
      SELECT m, list_transform(v, lambda x: x * sign(top)) AS v FROM (
        SELECT m, v, (SELECT arg_max(x, abs(x)) FROM (SELECT unnest(v) AS x)) AS top FROM {name} WHERE step = 100)
    )"""


_DEFLATED = "SELECT list_transform(range(1, 5), lambda i: list_transform(range(1, 5), lambda j: m[i][j] - list_dot_product(v, " + _TIMES + ") * v[i] * v[j])) AS m FROM p1_end"


@query(
    "pca",
    f"""WITH RECURSIVE c AS (SELECT {_COV} AS m FROM lineitem), {_power_sql("p1", "SELECT m FROM c")}, {_power_sql("p2", _DEFLATED)}
      SELECT k AS component, n AS column_name, round(w, 6) + 0.0 AS weight FROM (
        SELECT 1 AS k, unnest([{", ".join(f"'{c}'" for c in _PCA)}]) AS n, unnest(v) AS w FROM p1_end UNION ALL SELECT 2, unnest([{", ".join(f"'{c}'" for c in _PCA)}]), unnest(v) FROM p2_end)""",
)
def pca(spark, sf_dir):
    """The weights of the components, as the projections of all rows show them: their covariances with the columns."""
    lineitem = fixtures.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_PCA)
    kept = lineitem.select("*", *[F.col(c).alias(f"x_{c}") for c in _PCA])
    parts = prepare.pca(kept, list(_PCA), 2)
    weight = lambda k, c: (F.covar_pop(f"pc{k}", f"x_{c}") / F.var_pop(f"pc{k}"))
    rows = [F.struct(F.lit(k).alias("component"), F.lit(c).alias("column_name"), (F.round(weight(k, c), 6) + 0.0).alias("weight")) for k in (1, 2) for c in _PCA]
    return parts.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


# Sketches that merge, and heavy hitters

_SKETCHED = ("event_type", "user_id", "value")


@query(
    "profile_by_day",
    f"WITH {EV} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_present, {n} AS n_distinct, {f'round(min({c})::DOUBLE, 6)' if c != 'event_type' else 'NULL::DOUBLE'} AS low, {f'round(max({c})::DOUBLE, 6)' if c != 'event_type' else 'NULL::DOUBLE'} AS high, true AS near FROM ev"
        for c, n in (("event_type", "count(DISTINCT event_type)"), ("user_id", "round(count(DISTINCT user_id) / 200.0)::BIGINT"), ("value", "NULL::BIGINT"))
    ),
)
def profile_by_day(spark, sf_dir):
    """The profile of all days from stored sketches of each, written in two goes.

    Numbers of distinct values are compared exactly where they are few, in steps of 200 where a few hundred, and with the exact ones within
    the stated error otherwise (near); so are ranks of quantiles.
    """
    e, path = fixtures.events_gaps(spark, sf_dir).withColumn("day", F.to_date("ts")), scratch_path(spark, "days")
    for part in (F.dayofmonth("ts") < 20, F.dayofmonth("ts") >= 20):
        sketches.sketch_columns(e.filter(part), list(_SKETCHED), ["day"]).write.mode("append").parquet(path)
    shares = (0.25, 0.5, 0.75)
    united = sketches.unite_profiles(spark.read.parquet(path), list(shares))
    found = {r.column_name: r for r in united.collect()}
    exact = e.agg(*[F.count_distinct(c).alias(c) for c in _SKETCHED]).first()
    ranks = e.agg(*[F.count_if(F.col(c) <= q).alias(f"{c}{i}") for c in _SKETCHED[1:] for i, q in enumerate(found[c].quantiles)], *[F.count_if(F.col(c) < q).alias(f"{c}{i}below") for c in _SKETCHED[1:] for i, q in enumerate(found[c].quantiles)]).first()
    rows = []
    for c, r in found.items():
        near = abs(r.n_distinct - exact[c]) <= 0.024 * exact[c] + 0.5
        for i, s in enumerate(shares if r.quantiles else ()):
            near = near and ranks[f"{c}{i}below"] - 0.0025 * r.n_present - 1 <= s * r.n_present <= ranks[f"{c}{i}"] + 0.0025 * r.n_present + 1
        shown = {"event_type": r.n_distinct, "user_id": round(r.n_distinct / 200), "value": None}[c]
        rows.append((c, r.n_rows, r.n_present, shown, r.low, r.high, near))
    return rounded(spark.createDataFrame(rows, "column_name string, n_rows long, n_present long, n_distinct long, low double, high double, near boolean"), "low", "high")


_SKEWED = "CASE WHEN l_partkey % 10 = 0 THEN l_partkey ELSE l_partkey // 1000 END"


@query("heavy_hitters", f"SELECT CAST({_SKEWED} AS VARCHAR) AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM lineitem), 2) AS pct FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 50")
def heavy_hitters(spark, sf_dir):
    """A column of a few very frequent values and many rare ones; parts are counted in thousands but for round numbers."""
    li = fixtures.load(spark, sf_dir, "lineitem")
    skewed = F.when(F.col("l_partkey") % 10 == 0, F.col("l_partkey")).otherwise(F.floor(F.col("l_partkey") / 1000))
    return sketches.heavy_hitters(li.select(skewed.alias("v")), "v")


# What a treatment changed


@query(
    "cell_changes",
    f"""WITH {EV}, f AS (SELECT * REPLACE (CAST(user_id AS VARCHAR) AS user_id, coalesce(value, (SELECT median(value) FROM ev)) AS value, coalesce(event_type, 'unknown') AS event_type) FROM ev),
      d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1), {bounds_sql("iqr", "d", "value")},
      a AS (SELECT event_id, event_type, CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END AS value FROM d, b),
      m AS (SELECT ev.event_type AS t0, a.event_type AS t1, ev.value AS v0, a.value AS v1, a.event_id IS NULL AS gone FROM ev LEFT JOIN a USING (event_id)),
      c AS (SELECT NULL AS column_name, 'row gone' AS kind FROM m WHERE gone
        UNION ALL SELECT 'event_type', CASE WHEN t0 IS NULL THEN 'filled' ELSE 'changed' END FROM m WHERE NOT gone AND t0 IS DISTINCT FROM t1
        UNION ALL SELECT 'value', CASE WHEN v0 IS NULL THEN 'filled' ELSE 'changed' END FROM m WHERE NOT gone AND v0 IS DISTINCT FROM v1)
      SELECT column_name, kind, count(*) AS n FROM c GROUP BY ALL""",
)
def cell_changes(spark, sf_dir):
    """What the whole pipeline did to the events."""
    events = fixtures.events_gaps(spark, sf_dir)
    return changes.cell_changes(events, FULL.apply(events, order_by="event_id", on_error="null", written=True), ["event_id"])


@query("change_examples", "SELECT o_orderkey, 'o_totalprice' AS column_name, CASE WHEN o_orderkey % 3 = 0 THEN 'nulled' ELSE 'filled' END AS kind FROM orders WHERE o_orderkey % 3 < 2 QUALIFY row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY o_orderkey) <= 5")
def change_examples(spark, sf_dir):
    o, key = fixtures.load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("o_orderkey") % 3
    before, after = (o.withColumn("o_totalprice", F.when(key != i, F.col("o_totalprice"))) for i in (1, 0))
    return changes.change_examples(before, after, ["o_orderkey"]).select("o_orderkey", "column_name", "kind")


# Joins in time

_PLACED = "TIMESTAMP '2024-01-01' + to_seconds((o_orderkey * 7919) % 2592000)"


def _asof_sql(on: str, by: str) -> str:
    return f"""SELECT event_id, right_o_orderkey FROM events e ASOF LEFT JOIN (SELECT max(o_orderkey) AS right_o_orderkey, {by} {_PLACED} AS at FROM orders GROUP BY ALL) o ON {on} e.ts >= o.at"""


def _placed_orders(spark, sf_dir) -> DataFrame:
    """Orders with a time in the month of the events."""
    second = F.make_dt_interval(secs=((F.col("o_orderkey") * 7919) % 2592000).cast("decimal(18,6)"))
    return fixtures.load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("buyer"), (F.lit("2024-01-01").cast("timestamp_ntz") + second).alias("at"))


@query("asof_join", _asof_sql("e.user_id = o.buyer AND", "o_custkey % 150 AS buyer,"))
def asof_join(spark, sf_dir):
    """To each event its user's last order before it."""
    e = fixtures.load(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return asof.asof_join(e, _placed_orders(spark, sf_dir), "ts", "at", [("user_id", "buyer")], ["o_orderkey"]).select("event_id", "right_o_orderkey")


@query("asof_join_all", _asof_sql("", ""))
def asof_join_all(spark, sf_dir):
    """To each event the last order of all before it: no key to deal out by."""
    e = fixtures.load(spark, sf_dir, "events").select("event_id", "ts")
    return asof.asof_join(e, _placed_orders(spark, sf_dir), "ts", "at", [], ["o_orderkey"]).select("event_id", "right_o_orderkey")


# Preparation in two steps


@query("fitted_scale", "WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events WHERE event_id % 3 = 0) SELECT event_id, round((value - m) / s, 6) AS value FROM events, s WHERE event_id % 3 <> 0")
def fitted_scale(spark, sf_dir):
    """Fitted on a third of the events, applied to the others by its JSON form."""
    e = fixtures.load(spark, sf_dir, "events").select("event_id", "value")
    model = fitted.Fitted.from_json(fitted.fit(e.filter("event_id % 3 = 0"), "standard", ["value"]).to_json())
    return rounded(model.transform(e.filter("event_id % 3 <> 0")), "value")


@query(
    "fitted_ordinal",
    "WITH t AS (SELECT DISTINCT event_type AS v FROM events WHERE event_id % 3 = 0), f AS (SELECT list(v ORDER BY v) AS all_v FROM t), k AS (SELECT list_filter(all_v, lambda x: x <> all_v[1]) AS v FROM f) SELECT event_id, CAST(CASE WHEN list_contains(v, event_type) THEN list_position(v, event_type) - 1 ELSE len(v) END AS INTEGER) AS event_type FROM events, k WHERE event_id % 3 <> 0",
)
def fitted_ordinal(spark, sf_dir):
    """One type is kept from the fit; its events get the place after the last."""
    e = fixtures.load(spark, sf_dir, "events").select("event_id", "event_type")
    seen = e.filter("event_id % 3 = 0")
    least = seen.agg(F.min("event_type")).first()[0]
    model = fitted.fit(seen.filter(F.col("event_type") != least), "ordinal", "event_type", unseen="other")
    return model.transform(e.filter("event_id % 3 <> 0"))


@query("encode_sparse", "WITH t AS (SELECT l_partkey AS k, row_number() OVER (ORDER BY CAST(l_partkey AS VARCHAR)) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT l_partkey FROM lineitem)) SELECT l_orderkey, l_linenumber, CAST(n AS INTEGER) AS size, CAST(i AS INTEGER) AS place, 1.0::DOUBLE AS value FROM lineitem JOIN t ON k = l_partkey")
def encode_sparse(spark, sf_dir):
    """Thousands of parts as sparse vectors; shown by their size, index and value."""
    li = fixtures.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    encoded = fitted.sparse_one_hot(li, "l_partkey", fitted.dictionary(li, "l_partkey"), "vector")
    inner = F.unwrap_udt("vector")
    return encoded.select("l_orderkey", "l_linenumber", inner["size"].alias("size"), inner["indices"][0].alias("place"), inner["values"][0].alias("value"))


# Streaming


@query("stream_clean", f"WITH {EV} SELECT event_id, user_id, coalesce(event_type, 'unknown') AS event_type, CASE WHEN value < 10 THEN 10.0 WHEN value > 200 THEN 200.0 ELSE value END AS value FROM ev")
def stream_clean(spark, sf_dir):
    static = fixtures.load(spark, sf_dir, "events")
    # As a pattern: a stream's source takes a file or a folder that way, but no plain file.
    stream = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/events.parque[t]")
    gaps = stream.select("event_id", "user_id", F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    cleaned = clean.clean_stream(gaps, missing=[{"column": "event_type", "action": "constant", "value": "unknown"}], bounds={"value": (10, 200)})
    path = scratch_path(spark, "stream")
    clean.write_stream(cleaned, path, f"{path}-state").awaitTermination()
    return spark.read.schema(cleaned.schema).parquet(path)


@query("stream_first_rows", f"WITH {EV} SELECT DISTINCT user_id, event_type FROM ev")
def stream_first_rows(spark, sf_dir):
    """A stream of events without repetitions of a user and type, run twice on one checkpoint."""
    static = fixtures.load(spark, sf_dir, "events")
    path = scratch_path(spark, "first-rows")
    for _ in range(2):
        stream = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/events.parque[t]")
        gaps = stream.select("event_id", "ts", "user_id", F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"))
        clean.write_stream(stream_duplicates.first_rows_stream(gaps, ["user_id", "event_type"], "ts", "60 days"), path, f"{path}-state").awaitTermination()
    return spark.read.parquet(path).select("user_id", "event_type")


# Sources beyond the round trips: what is sniffed, broken rows, and every JSON layout


def _typed_orders(df: DataFrame) -> DataFrame:
    return df.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority").withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@query("csv_sniffed", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_sniffed(spark, sf_dir):
    """Separator, quotes, types and line breaks of a file that nothing is told of."""
    path = scratch_path(spark, "semicolons")
    fixtures.load(spark, sf_dir, "orders").write.options(header=True, sep=";").csv(path)
    return _typed_orders(files.read_dataset(spark, path, "csv"))


@query("csv_latin1", "SELECT n_nationkey, 'é ' || n_name || ' ü' AS n_name FROM nation")
def csv_latin1(spark, sf_dir):
    path = scratch_path(spark, "latin1")
    n = fixtures.load(spark, sf_dir, "nation")
    n.select("n_nationkey", F.concat(F.lit("é "), "n_name", F.lit(" ü")).alias("n_name")).coalesce(1).write.options(header=True, encoding="ISO-8859-1").csv(path)
    return files.read_csv(spark, path).select(F.col("n_nationkey").cast(n.schema["n_nationkey"].dataType).alias("n_nationkey"), "n_name")


@query("csv_ragged", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0")
def csv_ragged(spark, sf_dir):
    """Rows with a value too few or too many are left out."""
    path, o = scratch_path(spark, "ragged"), fixtures.load(spark, sf_dir, "orders")
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")), F.when(F.col("o_orderkey") % 11 == 0, "more").otherwise(F.when(F.col("o_orderkey") < 0, "")))
    # Both faults at once would make a row of the right length.
    line = F.when((F.col("o_orderkey") % 77 == 0), F.concat(line, F.lit(",and,more"))).otherwise(line)
    # The whole line as one column, under a separator that it doesn't hold, so that nothing is quoted.
    o.select(line.alias("o_orderkey,o_orderstatus,o_orderpriority")).write.options(header=True, sep="\x01").csv(path)
    return files.read_csv(spark, path, on_corrupt="drop").withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@query("csv_corrupt_rows", "SELECT CAST(count_if(o_orderkey % 7 = 0 OR o_orderkey % 11 = 0) AS BIGINT) AS n_corrupt FROM orders")
def csv_corrupt_rows(spark, sf_dir):
    """The number of rows that do not fit, as the error that loading raises gives it."""
    csv_path = scratch_path(spark, "corrupt")
    o = fixtures.load(spark, sf_dir, "orders")
    short, long = F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") % 11 == 0
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.when(~short, F.col("o_orderstatus")), F.when(long, "x,y"))
    o.select(line.alias("o_orderkey,o_orderstatus")).write.options(header=True, sep="\x01").csv(csv_path)
    try:
        files.read_csv(spark, csv_path)
        found = 0
    except ValueError as e:
        found = int(str(e).split(" ")[0])
    return spark.range(1).select(F.lit(found).cast("long").alias("n_corrupt"))


@query("csv_counted", "SELECT count(*) AS n_rows, count(DISTINCT o_orderstatus) AS n_statuses FROM orders")
def csv_counted(spark, sf_dir):
    """A CSV's rows and one of its columns, without a use of the others."""
    path = scratch_path(spark, "counted")
    fixtures.load(spark, sf_dir, "orders").write.options(header=True).csv(path)
    df = files.read_dataset(spark, path, "csv")
    return spark.range(1).select(F.lit(df.count()).alias("n_rows"), F.lit(profile.top_values(df, "o_orderstatus").count()).cast("long").alias("n_statuses"))


@query("csv_card", "SELECT count(*) AS row_count, 6::BIGINT AS column_count, true AS has_size FROM orders")
def csv_card(spark, sf_dir):
    """The card of a CSV."""
    path = scratch_path(spark, "card")
    fixtures.load(spark, sf_dir, "orders").write.options(header=True).csv(path)
    card = files.dataset_card(files.read_dataset(spark, path, "csv"), "orders", path)
    return spark.createDataFrame([(card["row_count"], card["column_count"], card["size_bytes"] > 0)], "row_count long, column_count long, has_size boolean")


def _with_late_line(spark, sf_dir, name: str, last: str, **options) -> str:
    """The orders as a CSV in files by ranges of their key, the last line alone with ``last`` as its priority."""
    path, o = scratch_path(spark, name), fixtures.load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    most = o.agg(F.max("o_orderkey")).first()[0]
    o = o.withColumn("o_orderpriority", F.when(F.col("o_orderkey") == most, last).otherwise(F.col("o_orderpriority")))
    o.repartitionByRange(2, "o_orderkey").sortWithinPartitions("o_orderkey").write.options(header=True, quote='"', escape='"', **options).csv(path)
    return path


def _late_sql(last: str) -> str:
    return f"SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN {last} ELSE o_orderpriority END AS o_orderpriority FROM orders"


@query("csv_late_break", _late_sql("'first' || chr(10) || 'second, \"third\"'"))
def csv_late_break(spark, sf_dir):
    """The one value with a line break is the file's last."""
    path = _with_late_line(spark, sf_dir, "late-break", 'first\nsecond, "third"')
    return files.read_dataset(spark, path, "csv").withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@query("csv_late_charset", _late_sql("'tr\u00e8s \u00fcber'"))
def csv_late_charset(spark, sf_dir):
    """The only bytes that are no UTF-8 are in the file's last line."""
    path = _with_late_line(spark, sf_dir, "late-charset", "tr\u00e8s \u00fcber", encoding="ISO-8859-1")
    return files.read_dataset(spark, path, "csv").withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@query("csv_windows", _late_sql("chr(8220) || chr(8364) || chr(8221)"))
def csv_windows(spark, sf_dir):
    """Bytes that only Windows-1252 gives characters, in the last line; written as the controls that ISO-8859-1 has there."""
    path = _with_late_line(spark, sf_dir, "windows", "“€”".encode("cp1252").decode("latin-1"), encoding="ISO-8859-1")
    return files.read_dataset(spark, path, "csv").withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@query("csv_utf16", _late_sql("chr(8364)"))
def csv_utf16(spark, sf_dir):
    """UTF-16 without a mark, told by its zero bytes."""
    path = _with_late_line(spark, sf_dir, "utf16", "€", encoding="UTF-16LE")
    return files.read_dataset(spark, path, "csv").withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


_CUSTOMER_COLUMNS = ("c_custkey", "c_name", "c_nationkey")
_CUSTOMER = f"SELECT {', '.join(_CUSTOMER_COLUMNS)} FROM customer"


def _document(layout: str):
    """Customers as one JSON document of a layout."""
    key, row = F.col("c_custkey").cast("string"), F.struct(*_CUSTOMER_COLUMNS)
    texts = F.array(*[F.col(c).cast("string") for c in _CUSTOMER_COLUMNS])
    if layout == "split":
        return F.to_json(F.struct(F.array(*map(F.lit, _CUSTOMER_COLUMNS)).alias("columns"), F.collect_list(F.col("c_custkey")).alias("index"), F.collect_list(texts).alias("data")))
    if layout == "values":
        return F.to_json(F.collect_list(texts))
    if layout == "index":
        return F.to_json(F.map_from_entries(F.collect_list(F.struct(key, row))))
    return F.to_json(F.struct(*[F.map_from_entries(F.collect_list(F.struct(key, F.col(c)))).alias(c) for c in _CUSTOMER_COLUMNS]))


def _layout(name: str) -> None:
    @query(f"json_{name}", _CUSTOMER)
    def read(spark, sf_dir):
        """Written as a folder of documents of a few dozen customers each, read by the layout that they show."""
        path, customer = scratch_path(spark, f"customer-{name}"), fixtures.load(spark, sf_dir, "customer")
        documents = customer.groupBy(F.floor(F.col("c_custkey") / 500).alias("part")).agg(_document(name).alias("value"))
        # A file per document.
        documents.repartition("part").write.partitionBy("part").text(path)
        found = files.read_json(spark, path)
        found = found.toDF(*_CUSTOMER_COLUMNS) if name == "values" else found.select(*_CUSTOMER_COLUMNS)
        return found.withColumns({"c_custkey": F.col("c_custkey").cast("long"), "c_nationkey": F.col("c_nationkey").cast("int")})


for _name in ("split", "index", "columns", "values"):
    _layout(_name)


_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
_NATION_COLUMNS = ("n_nationkey", "n_name", "n_regionkey")


@query("json_lines_nested", "SELECT event_id, user_id AS \"user.id\", event_type AS \"user.did\", value FROM events")
def json_lines_nested(spark, sf_dir):
    """Lines whose first value is an object, as most logs have them."""
    path, e = scratch_path(spark, "nested"), fixtures.load(spark, sf_dir, "events")
    nested = e.select(F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("did")).alias("user"), "event_id", "value")
    files.write_dataset(nested, path, "json")
    return files.read_dataset(spark, path, "json").select("event_id", "`user.id`", "`user.did`", "value")


@query("json_lines_sniffed", _NATION)
def json_lines_sniffed(spark, sf_dir):
    path = scratch_path(spark, "lines")
    files.write_dataset(fixtures.load(spark, sf_dir, "nation").select(*_NATION_COLUMNS), path, "json")
    return files.read_dataset(spark, path, "json").select(*_NATION_COLUMNS)


@query("format_gate", "SELECT f.name, f.kind, CASE WHEN f.kind IS NOT NULL THEN n END AS n_rows FROM (VALUES ('c.csv', 'csv'), ('c.json', 'json'), ('c.parquet', 'parquet'), ('c.xlsx', NULL)) f(name, kind), (SELECT count(*) AS n FROM customer)")
def format_gate(spark, sf_dir):
    """The customers in files whose names tell their formats, read by those names; other names are refused."""
    root, rows = scratch_path(spark, "gate"), []
    for name in ("c.csv", "c.json", "c.parquet", "c.xlsx"):
        try:
            files.write_dataset(fixtures.load(spark, sf_dir, "customer"), f"{root}/{name}", name.rpartition(".")[2])
            rows.append((name, files.format_of(f"{root}/{name}"), files.read_dataset(spark, f"{root}/{name}").count()))
        except ValueError:
            rows.append((name, None, None))
    return spark.createDataFrame(rows, "name string, kind string, n_rows long")


@query("dataset_card", f"SELECT 'orders' AS name, count(*) AS row_count, 3::BIGINT AS column_count, CAST(count_if(lower(trim({MARKED})) IN ('', 'na', 'null')) AS BIGINT) AS replaced_status, true AS has_size, true AS has_time FROM orders")
def dataset_card(spark, sf_dir):
    card = files.dataset_card(fixtures.orders_markers(spark, sf_dir), "orders", f"{sf_dir}/orders.parquet", markers=True)
    row = (card["name"], card["row_count"], card["column_count"], card["replaced_markers"]["status_txt"], card["size_bytes"] > 0, bool(card["processed_at"]))
    return spark.createDataFrame([row], "name string, row_count long, column_count long, replaced_status long, has_size boolean, has_time boolean")


@query("adaptive_preview", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '…' ELSE text END AS text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents ORDER BY documents.doc_id LIMIT 10")
def adaptive_preview(spark, sf_dir):
    shown = normalise.adaptive_preview(fixtures.load(spark, sf_dir, "documents").orderBy("doc_id"))
    return spark.createDataFrame([tuple(r.values()) for r in shown], "doc_id string, text string, lang string, source string, n_chars string")


@query("preview_typed", "SELECT 0::BIGINT AS row_no, 'bigint' AS n_nationkey, 'string' AS n_name UNION ALL SELECT * FROM (SELECT row_number() OVER (ORDER BY n_nationkey), CAST(n_nationkey AS VARCHAR), n_name FROM nation ORDER BY n_nationkey LIMIT 10)")
def preview_typed(spark, sf_dir):
    nation = fixtures.load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    return normalise.typed_preview(nation.orderBy("n_nationkey"))


@query("session_settings", """SELECT t.*, n_events FROM (VALUES ('spark.master', 'SILTWORKS_MASTER', 'local[*]'), ('spark.driver.memory', 'SILTWORKS_DRIVER_MEMORY', '8g'), ('spark.driver.maxResultSize', 'SILTWORKS_MAX_RESULT', '2g'),
  ('spark.sql.shuffle.partitions', 'SILTWORKS_SHUFFLE_PARTITIONS', '200'), ('spark.sql.execution.arrow.maxRecordsPerBatch', 'SILTWORKS_ARROW_ROWS', '20000')) t(setting, variable, preset), (SELECT count(*) AS n_events FROM events)""")
def session_settings(spark, sf_dir):
    """The settings of a new session and the variables that change them (folders, which follow the machine, are left out), and the events that the session in use reads."""
    known = [(k, env, default) for k, (env, default) in session.SETTINGS.items() if not k.endswith(".dir")]
    n = fixtures.load(session.session(), sf_dir, "events").count()
    return spark.createDataFrame([(*k, n) for k in known], "setting string, variable string, preset string, n_events long")


# Tables of what is allowed, checks before a treatment, and what a treatment would do

_ALLOWED = {
    "format": {"string": "to_boolean,to_date,to_integer,to_numeric,to_string", "numeric": "to_boolean,to_integer,to_numeric,to_string", "boolean": "to_boolean,to_string", "temporal": "to_date,to_string"},
    "missing": {"string": "bfill,constant,drop_rows,ffill,mode", "numeric": "bfill,constant,drop_rows,ffill,mean,median,mode", "boolean": "bfill,constant,drop_rows,ffill,mode", "temporal": "bfill,constant,drop_rows,ffill,mode"},
}


_KINDS = {"event_id": "numeric", "ts": "temporal", "user_id": "numeric", "event_type": "string", "value": "numeric", "props": "string"}


@query("allowed_actions", f"WITH {EV} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{step}' AS step, '{kinds[_KINDS[c]]}' AS actions, count(*) - count({c}) AS n_missing FROM ev" for step, kinds in _ALLOWED.items() for c in EVENTS))
def allowed_actions(spark, sf_dir):
    """What is offered for each column of the events, and how many of its values are missing."""
    ev = fixtures.events_gaps(spark, sf_dir)
    offered = [(f.name, step, ",".join(sorted(given(f.dataType)))) for step, given in (("format", formats.allowed_format_actions), ("missing", missing.allowed_missing_strategies)) for f in ev.schema]
    return spark.createDataFrame(offered, "column_name string, step string, actions string").join(missing.missing_counts(ev), "column_name")


@query("format_validation", f"""SELECT 'price_txt' AS column_name, 'to_integer' AS action, CAST(count_if({CENTS} % 100 <> 0) AS BIGINT) AS n_bad,
    min(CASE WHEN {CENTS} % 100 <> 0 THEN CAST({CENTS} // 100 AS VARCHAR) || ',' || lpad(CAST({CENTS} % 100 AS VARCHAR), 2, '0') END) AS example FROM orders
  UNION ALL SELECT 'price_txt', 'to_date', count(*), min(CAST({CENTS} // 100 AS VARCHAR) || ',' || lpad(CAST({CENTS} % 100 AS VARCHAR), 2, '0')) FROM orders
  UNION ALL SELECT 'date_txt', 'to_date', 0, NULL UNION ALL SELECT 'key_txt', 'to_numeric', 0, NULL""")
def format_validation(spark, sf_dir):
    rules = [{"column": c, "action": a} for c, a in (("price_txt", "to_integer"), ("price_txt", "to_date"), ("date_txt", "to_date"), ("key_txt", "to_numeric"))]
    return formats.format_problems(fixtures.orders_text(spark, sf_dir), rules)


_BOX_SQL = "round(min({v}), 6) AS min, round(quantile_cont({v}, 0.25), 6) AS q1, round(median({v}), 6) AS median, round(quantile_cont({v}, 0.75), 6) AS q3, round(max({v}), 6) AS max"


@query(
    "outlier_before_after",
    f"""WITH {EV}, {bounds_sql("iqr", "ev", "value")}, a AS (SELECT CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END AS value, lo, hi FROM ev, b)
      SELECT 'value' AS column_name, 'before' AS stage, count(*) AS n_rows, count(value) AS n_values, CAST(count_if({_OUT}) AS BIGINT) AS n_outliers, {_BOX_SQL.replace("{v}", "value")} FROM ev, b
      UNION ALL SELECT 'value', 'after', count(*), count(value), CAST(count_if({_OUT}) AS BIGINT), {_BOX_SQL.replace("{v}", "value")} FROM a""",
)
def outlier_before_after(spark, sf_dir):
    found = outliers.before_after(fixtures.events_gaps(spark, sf_dir), [{"column": "value", "method": "iqr", "action": "cap"}])
    return rounded(found, *outliers.BOX)


@query(
    "column_detail",
    f"""WITH {EV}, {bounds_sql("mad", "ev", "value")}, e AS (SELECT min(value) AS least, max(value) AS most FROM ev),
      h AS (SELECT least(floor((value - least) / ((most - least) / 50)), 49) AS bucket, count(*) AS n FROM ev, e WHERE value IS NOT NULL GROUP BY 1), x AS (SELECT {_BOX_SQL.replace("{v}", "value")} FROM ev)
      SELECT 'box' AS part, 'min' AS label, min AS value FROM x UNION ALL SELECT 'box', 'q1', q1 FROM x UNION ALL SELECT 'box', 'median', median FROM x UNION ALL SELECT 'box', 'q3', q3 FROM x UNION ALL SELECT 'box', 'max', max FROM x
      UNION ALL SELECT 'bounds', 'low', round(lo, 6) FROM b UNION ALL SELECT 'bounds', 'high', round(hi, 6) FROM b
      UNION ALL SELECT 'histogram', CAST(CAST(bucket AS INTEGER) AS VARCHAR), CAST(n AS DOUBLE) FROM h""",
)
def column_detail(spark, sf_dir):
    return rounded(outliers.column_detail(fixtures.events_gaps(spark, sf_dir), "value", method="mad"), "value")


@query("sample_fraction", """WITH k AS (SELECT event_id, value, least(1.0, greatest(1e-4, 5000 / greatest(1, count(*) OVER ()))) AS share FROM events WHERE value IS NOT NULL),
  m AS (SELECT value, md5(CAST(event_id AS VARCHAR) || ':42') AS turn, share FROM k)
  SELECT value FROM m WHERE CAST('0x' || left(turn, 8) AS BIGINT) < share * 4294967296 ORDER BY turn, value LIMIT 5000""")
def sample_fraction(spark, sf_dir):
    return outliers.sample_fraction(fixtures.load(spark, sf_dir, "events"), "value", key="event_id")


# Approximate modes, by how far their ranks or counts are off


def _rank_error(df: DataFrame, name: str, asked: list[float], found: list[float]) -> DataFrame:
    """share asked, whether the share of values below and up to the value found encloses it within 0.002, and the number of values."""
    v = F.col(name)
    ends = [(F.lit(s).alias("share"), (F.count_if(v < q) / F.count(v) <= s + 0.002) & (F.count_if(v <= q) / F.count(v) >= s - 0.002)) for s, q in zip(asked, found)]
    row = df.agg(F.array(*[F.struct(s, within.alias("within"), F.count(v).alias("n_values")) for s, within in ends]).alias("rows"))
    return row.select(F.inline("rows"))


@query("missing_median_approx", f"WITH {EV} SELECT 0.5::DOUBLE AS share, true AS within, count(value) AS n_values FROM ev")
def missing_median_approx(spark, sf_dir):
    gaps = fixtures.events_gaps(spark, sf_dir)
    filled = missing.apply_missing(gaps, [{"column": "value", "action": "median"}], approximate=True)
    value = filled.join(gaps.filter("value is null").select("event_id"), "event_id", "left_semi").agg(F.max("value"), F.min("value")).first()
    return _rank_error(gaps, "value", [0.5], [value[0] if value[0] == value[1] else float("inf")])


@query("outlier_bounds_approx", f"WITH {EV} SELECT unnest([0.25::DOUBLE, 0.75]) AS share, true AS within, count(value) AS n_values FROM ev")
def outlier_bounds_approx(spark, sf_dir):
    gaps = fixtures.events_gaps(spark, sf_dir)
    low, high = outliers.outlier_bounds(gaps, ["value"], approximate=True).select("low", "high").first()
    spread = (high - low) / 4  # low = q1 - 1.5 spread, high = q3 + 1.5 spread
    return _rank_error(gaps, "value", [0.25, 0.75], [low + 1.5 * spread, high - 1.5 * spread])


@query("distinct_approx", f"WITH {EV} " + each(EVENTS, "SELECT '{c}' AS column_name, count(DISTINCT {c}) + CAST(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_distinct, true AS near FROM ev"))
def distinct_approx(spark, sf_dir):
    gaps = fixtures.events_gaps(spark, sf_dir)
    both = profile.distinct_by_column(gaps, approximate=True).select("column_name", F.col("n_distinct").alias("about")).join(profile.distinct_by_column(gaps), "column_name")
    return both.select("column_name", "n_distinct", (F.abs(F.col("about") - F.col("n_distinct")) <= F.greatest(F.lit(1), F.col("n_distinct") * 0.15)).alias("near"))


@query("missing_preview_numeric", f"""WITH {EV}, e AS (SELECT min(value) AS lo, max(value) AS hi, CASE WHEN count(*) < 5000 THEN 50 ELSE 60 END AS bins FROM ev)
  SELECT round(least(floor((value - lo) / ((hi - lo) / bins)), bins - 1) * ((hi - lo) / bins) + lo, 6) AS label, count(*) AS n FROM ev, e WHERE value IS NOT NULL GROUP BY 1""")
def missing_preview_numeric(spark, sf_dir):
    return profile.missing_preview(fixtures.events_gaps(spark, sf_dir), "value").select(F.round(F.col("label").cast("double"), 6).alias("label"), "n")


# Pipelines as values, and windows of a stream


@query("pipeline_edited", """SELECT t.*, n AS n_rows FROM (SELECT 0 AS step_no, 'dataset' AS step, 'name' AS target, '' AS action, 'events' AS parameters UNION ALL SELECT 0, 'dataset', 'row_count', '', CAST(count(*) AS VARCHAR) FROM events
  UNION ALL SELECT 1, 'outliers', 'value', 'cap', '{"method": "z"}' UNION ALL SELECT 2, 'formats', 'user_id', 'to_string', '') t, (SELECT count(*) AS n FROM events)""")
def pipeline_edited(spark, sf_dir):
    """A step set again moves to the end, a removed one goes, of two rules for a column the last is in force; the card comes first, and the rows that the run leaves stand beside."""
    p = Pipeline().with_step("formats", [{"column": "user_id", "action": "to_integer"}]).with_step("missing", [{"column": "value", "action": "mean"}])
    p = p.with_step("outliers", [{"column": "value", "method": "iqr", "action": "drop"}, {"column": "value", "method": "z", "action": "cap"}])
    p = p.with_step("outliers", p.rules("outliers")).with_step("formats", [{"column": "user_id", "action": "to_string"}]).without("missing_values")
    assert p.cleared() == Pipeline()
    events = fixtures.load(spark, sf_dir, "events")
    card = files.dataset_card(events, "events")
    left = p.apply(events).count()
    return p.describe(spark, {k: card[k] for k in ("name", "row_count")}).withColumn("n_rows", F.lit(left).cast("long"))


@query("completeness_stream", f"WITH {EV} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n_rows, count(value) AS n_value, count(event_type) AS n_event_type FROM ev GROUP BY 1")
def completeness_stream(spark, sf_dir):
    static = fixtures.load(spark, sf_dir, "events")
    stream = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/events.parque[t]")
    gaps = stream.select("ts", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"))
    counted, path = clean.completeness_stream(gaps, "ts", ["value", "event_type"]), scratch_path(spark, "windows")
    # Every batch gives all windows; the last batch's are the result.
    put = lambda batch, number: batch.write.mode("overwrite").parquet(path)
    counted.writeStream.outputMode("complete").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(counted.schema).parquet(path).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
