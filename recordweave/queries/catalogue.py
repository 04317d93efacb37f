"""The registered queries of the query algebra and of the record operators, each with its SQL.

The star-schema tables stand in for records: orders are entities, events are the change log and, per type and day, a
series; see ``book``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordweave.functions.names import identify
from recordweave.functions.times import instant_us
from recordweave.operators import history, imports, profile, querylog, series, text
from recordweave.operators.asof import asof_join
from recordweave.plans import diagnostics as diag
from recordweave.plans.planner import Book, Planner, ask, with_labels
from recordweave.plans.spec import FieldDef, TypeDef, parse
from recordweave.queries.replay_sql import FIRST_RECORDINGS, replay_sql
from recordweave.sources.tables import table
from recordweave.sources.views import flat_view

NOW = dt.datetime(2001, 8, 1, 12, tzinfo=dt.timezone.utc)
_date, _num, _int = FieldDef(format="date"), FieldDef("number"), FieldDef("integer")

TYPES = {
    "customer": TypeDef("customer", {"name": FieldDef(), "segment": FieldDef(), "balance": _num}),
    "order": TypeDef("order", {
        "status": FieldDef(enum=("P", "O", "F"), implies={"F": ["O"]}), "ordered_on": _date, "priority": FieldDef(), "amount": _num, "customer_id": FieldDef(ref="customer"),
    }),
    "line": TypeDef("line", {
        "status": FieldDef(), "flag": FieldDef(), "ordered_on": _date, "shipped_on": _date, "quantity": _num, "price": _num, "tax": _num, "part_id": FieldDef(ref="part"),
    }),
    "part": TypeDef("part", {"name": FieldDef(), "brand": FieldDef(), "kind": FieldDef(), "size": _int}),
    "daily": TypeDef("daily", {"event_type": FieldDef(), "day": _date, "n": _int, "total": _num}, "series", ("event_type",), "day"),
    "part_price": TypeDef("part_price", {"part_id": FieldDef(ref="part"), "day": _date, "close": _num}, "series", ("part_id",), "day"),
    "application": TypeDef("application", {
        "status": FieldDef(enum=("applied", "viewed", "passed", "rejected", "withdrawn"), implies={"passed": ["viewed"]}), "company_id": FieldDef(ref="company"),
        "applied_at": FieldDef(format="date", event={"kind": "created"}), "viewed_at": FieldDef(format="date", event={"kind": "status_changed", "to": "viewed"}),
    }),
}


def book(spark: SparkSession, d: str) -> Book:
    """Entities order, line, customer, part; series daily and part_price; applications with the change log."""
    t = lambda n: table(spark, d, n)
    b = Book(TYPES, now=NOW, zone="UTC", names={"customer": "name", "part": "name"})
    orders = t("orders")
    b.entities["order"] = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("ordered_on"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority"), F.col("o_totalprice").alias("amount"), F.col("o_custkey").alias("customer_id"),
    )
    b.entities["customer"] = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    b.entities["part"] = t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"))
    line = t("lineitem").join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    b.entities["line"] = line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"), F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("flag"),
        F.to_date("o_orderdate").alias("ordered_on"), F.to_date("l_shipdate").alias("shipped_on"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_tax").alias("tax"), F.col("l_partkey").alias("part_id"),
    )
    b.series["daily"] = t("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    b.series["part_price"] = t("lineitem").groupBy(F.col("l_partkey").alias("part_id"), F.to_date("l_shipdate").alias("day")).agg(F.max("l_extendedprice").alias("close"))
    return b


def record_book(spark: SparkSession, d: str) -> Book:
    """Applications of the stored projection with their change log (first recordings; ``applied`` from the projection)."""
    b = Book(TYPES, now=dt.datetime(2026, 10, 1, tzinfo=dt.timezone.utc), zone="Asia/Seoul")
    e = table(spark, d, "entities").where("type = 'application'").groupBy("id").agg(F.max_by(F.struct("doc", "retracted", "reached", "event_ids", "created_at"), "last_event_seq").alias("r")).select("id", "r.*")
    f = lambda n: F.get_json_object("doc", f"$.{n}")
    b.entities["application"] = e.select("id", "retracted", "reached", "created_at", f("status").alias("status"), f("company_id").alias("company_id"), f("applied_at").try_cast("date").alias("applied_at"), f("viewed_at").try_cast("date").alias("viewed_at"))
    log = table(spark, d, "record_events").where("entity_type = 'application'").groupBy("id").agg(F.min_by(F.struct("seq", "entity_id", "entity_type", "kind", "payload", "at", "recorded_by", "evidence", "at_precision"), "seq").alias("r")).select("id", "r.*")
    applied = e.select(F.explode("event_ids").alias("id"), F.lit(True).alias("applied"))
    b.events = log.join(applied, "id", "left").select(
        "id", "seq", "entity_id", "entity_type", "kind", F.get_json_object("payload", "$.to").alias("to"), F.get_json_object("payload", "$.from").alias("from"), instant_us(F.col("at")).alias("at_us"),
        F.substring("at", 1, 10).try_cast("date").alias("local_day"), F.col("recorded_by").alias("by"), "evidence", "at_precision", F.coalesce("applied", F.lit(False)).alias("applied"),
    )
    return b


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_ORDER = "(SELECT o_orderkey AS id, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS ordered_on, nullif(o_orderpriority, '5-LOW') AS priority, o_totalprice AS amount, o_custkey AS customer_id FROM orders)"
_LINE = "(SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, l_linestatus AS status, l_returnflag AS flag, CAST(o_orderdate AS DATE) AS ordered_on, CAST(l_shipdate AS DATE) AS shipped_on, l_quantity AS quantity, l_extendedprice AS price, l_tax AS tax, l_partkey AS part_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_DAILY = "(SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2)"
_PRICE = "(SELECT l_partkey AS part_id, CAST(l_shipdate AS DATE) AS day, max(l_extendedprice) AS close FROM lineitem GROUP BY 1, 2)"
_APP = """(SELECT id, retracted, reached, event_ids, doc->>'status' AS status, doc->>'company_id' AS company_id, TRY_CAST(doc->>'applied_at' AS DATE) AS applied_at, TRY_CAST(doc->>'viewed_at' AS DATE) AS viewed_at
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_event_seq DESC) AS rn FROM entities WHERE type = 'application') WHERE rn = 1)"""
_LOG = f"""(SELECT f.*, payload->>'to' AS "to", epoch_us(CAST("at" AS TIMESTAMPTZ)) AS at_us, CAST(substr("at", 1, 10) AS DATE) AS local_day, a.eid IS NOT NULL AS applied
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM record_events WHERE entity_type = 'application') WHERE rn = 1) f
  LEFT JOIN (SELECT DISTINCT unnest(event_ids) AS eid FROM {_APP}) a ON a.eid = f.id)"""


def spec(name: str, data: dict, sql: str, of: Callable[[SparkSession, str], Book] = book, rounded: tuple[str, ...] = (), fine: tuple[str, ...] = (), dates: tuple[str, ...] = ()) -> None:
    """Registers a specification; ``rounded`` columns become cents, ``dates`` text, so both engines print them alike."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return printed(ask(of(spark, d), data).rows, rounded, fine, dates)

    QUERIES[name], ORACLE_SQL[name] = run, sql


def whole(name: str, data: dict, columns: list[str], sql: str, of: Callable[[SparkSession, str], Book] = book, rounded: tuple[str, ...] = (), dates: tuple[str, ...] = ()) -> None:
    """Registers every row that matches a specification; a list alone has at most its limit of them."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return printed(ask(of(spark, d), data).matching.select(*columns), rounded, (), dates)

    QUERIES[name], ORACLE_SQL[name] = run, sql


def printed(rows: DataFrame, rounded: tuple[str, ...], fine: tuple[str, ...], dates: tuple[str, ...]) -> DataFrame:
    for c in rounded:
        rows = rows.withColumn(c, F.round(F.col(c).cast("double"), 2).cast("decimal(18,2)").cast("string"))
    for c in fine:
        rows = rows.withColumn(c, F.col(c).cast("decimal(18,4)").cast("string"))
    for c in dates:
        rows = rows.withColumn(c, F.col(c).cast("string"))
    return rows


def cents(x: str) -> str:
    return f"CAST(CAST(round(CAST({x} AS DOUBLE), 2) AS DECIMAL(18,2)) AS VARCHAR)"


_OR = {"entity_type": "order"}
spec("ent_count_filters", _OR | {"mode": "count", "filters": [{"field": "status", "op": "in", "value": ["O", "P"]}, {"field": "amount", "op": "gte", "value": 1000}, {"field": "priority", "op": "eq", "value": "1-URGENT"}]},
     f"SELECT count(*) AS n FROM {_ORDER} WHERE status IN ('O', 'P') AND amount >= 1000 AND priority = '1-URGENT'")
spec("ent_ne_null_safe", _OR | {"mode": "aggregate", "filters": [{"field": "priority", "op": "ne", "value": "1-URGENT"}, {"field": "priority", "op": "not_in", "value": ["2-HIGH"]}], "group_by": [{"field": "priority"}]},
     f"SELECT priority, count(*) AS n FROM {_ORDER} WHERE priority IS DISTINCT FROM '1-URGENT' AND (priority IS NULL OR priority NOT IN ('2-HIGH')) GROUP BY 1")
spec("ent_exists_missing", _OR | {"mode": "aggregate", "measures": [{"name": "has", "agg": "count", "where": [{"field": "priority", "op": "exists"}]}, {"name": "lacks", "agg": "count", "where": [{"field": "priority", "op": "missing"}]}]},
     f"SELECT CAST(sum((priority IS NOT NULL)::INT) AS BIGINT) AS has, CAST(sum((priority IS NULL)::INT) AS BIGINT) AS lacks, count(*) AS n FROM {_ORDER}")
spec("ent_contains_ci", {"entity_type": "part", "mode": "list", "filters": [{"field": "name", "op": "contains", "value": "RED"}], "list_fields": ["name", "brand"], "limit": 200},
     "SELECT p_partkey AS id, p_name AS name, p_brand AS brand FROM part WHERE contains(lower(p_name), 'red') ORDER BY id LIMIT 200")
whole("ent_contains_ci_matching", {"entity_type": "part", "mode": "list", "filters": [{"field": "name", "op": "contains", "value": "RED"}]}, ["id", "name", "brand"],
      "SELECT p_partkey AS id, p_name AS name, p_brand AS brand FROM part WHERE contains(lower(p_name), 'red')")
spec("ent_list_topk", _OR | {"mode": "list", "filters": [{"field": "status", "op": "eq", "value": "F"}], "list_fields": ["amount", "status"], "order_by": "amount", "descending": True, "limit": 50},
     f"SELECT id, amount, status FROM {_ORDER} WHERE status = 'F' ORDER BY amount DESC NULLS LAST, id LIMIT 50")
for _size, _fmt in (("day", "%Y-%m-%d"), ("week", "%Y-W%W"), ("month", "%Y-%m"), ("year", "%Y")):
    spec(f"ent_group_bucket_{_size}", _OR | {"mode": "aggregate", "group_by": [{"field": "ordered_on", "bucket": _size}, {"field": "status"}], "measures": [{"name": "total", "agg": "sum", "field": "amount"}]},
         f"SELECT strftime(ordered_on, '{_fmt}') AS ordered_on_{_size}, status, {cents('sum(amount)')} AS total, count(*) AS n FROM {_ORDER} GROUP BY 1, 2", rounded=("total",))
spec("ent_multi_measure_where", _OR | {"mode": "aggregate", "group_by": [{"field": "status"}], "measures": [
        {"name": "urgent", "agg": "count_if", "where": [{"field": "priority", "op": "eq", "value": "1-URGENT"}]}, {"name": "big", "agg": "avg", "field": "amount", "where": [{"field": "amount", "op": "gt", "value": 2000}]},
        {"name": "least", "agg": "min", "field": "amount"}, {"name": "most", "agg": "max", "field": "amount"}]},
     f"SELECT status, CAST(sum(CASE WHEN priority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS urgent, {cents('avg(CASE WHEN amount > 2000 THEN amount END)')} AS big, min(amount) AS least, max(amount) AS most, count(*) AS n FROM {_ORDER} GROUP BY 1", rounded=("big",))
spec("ent_median", {"entity_type": "line", "mode": "aggregate", "group_by": [{"field": "flag"}], "measures": [{"name": "mid", "agg": "median", "field": "price"}]},
     f"SELECT flag, CAST(CAST(median(price) AS DECIMAL(18,4)) AS VARCHAR) AS mid, count(*) AS n FROM {_LINE} GROUP BY 1", fine=("mid",))
spec("ent_having", _OR | {"mode": "aggregate", "group_by": [{"field": "ordered_on", "bucket": "month"}], "measures": [{"name": "mean", "agg": "avg", "field": "amount"}], "having": [{"measure": "count", "op": "gte", "value": 180}, {"measure": "mean", "op": "gt", "value": 1000}], "order_by": "count", "descending": True},
     f"SELECT strftime(ordered_on, '%Y-%m') AS ordered_on_month, {cents('avg(amount)')} AS mean, count(*) AS n FROM {_ORDER} GROUP BY 1 HAVING count(*) >= 180 AND avg(amount) > 1000", rounded=("mean",))
spec("ent_first_last_date", _OR | {"mode": "aggregate", "group_by": [{"field": "status"}], "measures": [{"name": "a", "agg": "first", "field": "ordered_on"}, {"name": "z", "agg": "last", "field": "ordered_on"}]},
     f"SELECT status, CAST(min(ordered_on) AS VARCHAR) AS a, CAST(max(ordered_on) AS VARCHAR) AS z, count(*) AS n FROM {_ORDER} GROUP BY 1", dates=("a", "z"))
spec("ent_relative_dates", {**_OR, "mode": "count", "filters": [{"field": "ordered_on", "op": "gte", "value": "@last_month_start-2m"}, {"field": "ordered_on", "op": "lte", "value": "@last_full_week_end(2001-06)"}]},
     f"SELECT count(*) AS n FROM {_ORDER} WHERE ordered_on BETWEEN DATE '2001-05-01' AND DATE '2001-06-24'")
spec("ent_expr_values", {"entity_type": "line", "mode": "aggregate", "values": [{"name": "unit", "expr": {"op": "div", "args": ["price", "quantity"]}}, {"name": "net", "expr": {"op": "sub", "args": ["unit", "tax", 1]}}], "group_by": [{"field": "status"}], "measures": [{"name": "mean", "agg": "avg", "field": "net"}, {"name": "most", "agg": "max", "field": "unit"}]},
     f"SELECT status, {cents('avg(price / nullif(quantity, 0) - tax - 1)')} AS mean, {cents('max(price / nullif(quantity, 0))')} AS most, count(*) AS n FROM {_LINE} GROUP BY 1", rounded=("mean", "most"))
spec("ent_order_by_value", {"entity_type": "line", "mode": "list", "values": [{"name": "took", "span": {"start": {"field": "ordered_on"}, "end": {"field": "shipped_on"}}, "unit": "days"}], "list_fields": ["part_id"], "order_by": "took", "descending": True, "limit": 30},
     f"SELECT DISTINCT ON (rn) id, part_id, took FROM (SELECT *, row_number() OVER (ORDER BY took DESC NULLS LAST, id) AS rn FROM (SELECT id, part_id, CAST(date_diff('day', ordered_on, shipped_on) AS DOUBLE) AS took FROM {_LINE})) WHERE rn <= 30")
spec("span_days_measures", {"entity_type": "line", "mode": "aggregate", "group_by": [{"field": "flag"}], "measures": [{"name": a, "agg": a if a != "mid" else "median", "span": {"start": {"field": "ordered_on"}, "end": {"field": "shipped_on"}}, "unit": "weeks"} for a in ("avg", "min", "max", "sum", "mid")]},
     f"SELECT flag, {', '.join(f'{cents(f'{fn}(w)')} AS {a}' for a, fn in (('avg', 'avg'), ('min', 'min'), ('max', 'max'), ('sum', 'sum'), ('mid', 'median')))}, count(*) AS n FROM (SELECT flag, date_diff('day', ordered_on, shipped_on) / 7.0 AS w FROM {_LINE}) GROUP BY 1", rounded=("avg", "min", "max", "sum", "mid"))
spec("span_elapsed_filter", {"entity_type": "line", "mode": "count", "elapsed": [{"start": {"field": "ordered_on"}, "end": {"field": "shipped_on"}, "unit": "weeks", "op": "gte", "value": 2}, {"start": {"field": "shipped_on"}, "unit": "days", "op": "lt", "value": 1500}]},
     f"SELECT count(*) AS n FROM {_LINE} WHERE date_diff('day', ordered_on, shipped_on) >= 14 AND date_diff('day', shipped_on, DATE '2001-08-01') < 1500")

_AP = {"entity_type": "application"}
spec("evt_count_by_kind", _AP | {"source": "events", "mode": "aggregate", "group_by": [{"field": "kind"}, {"field": "at", "bucket": "month"}], "measures": [{"name": "told", "agg": "count"}]},
     f"SELECT kind, strftime(local_day, '%Y-%m') AS at_month, count(*) AS told, count(*) AS n FROM {_LOG} GROUP BY 1, 2", of=record_book)
spec("evt_local_day_filter", _AP | {"source": "events", "mode": "aggregate", "filters": [{"field": "at", "op": "gte", "value": "2025-06-01"}, {"field": "at", "op": "lte", "value": "2025-06-30"}], "group_by": [{"field": "by"}]},
     f"SELECT recorded_by AS \"by\", count(*) AS n FROM {_LOG} WHERE at_us >= epoch_us(TIMESTAMPTZ '2025-06-01 00:00:00+09') AND at_us < epoch_us(TIMESTAMPTZ '2025-07-01 00:00:00+09') GROUP BY 1", of=record_book)
spec("evt_record_semi", _AP | {"source": "events", "mode": "aggregate", "record_filters": [{"field": "status", "op": "eq", "value": "rejected"}], "filters": [{"field": "kind", "op": "eq", "value": "updated"}], "group_by": [{"field": "kind"}]},
     f"SELECT kind, count(*) AS n FROM {_LOG} WHERE kind = 'updated' AND entity_id IN (SELECT id FROM {_APP} WHERE NOT retracted AND status = 'rejected') GROUP BY 1", of=record_book)
spec("evt_reached", _AP | {"mode": "count", "filters": [{"field": "status", "op": "reached", "value": "viewed"}]},
     f"SELECT count(*) AS n FROM {_APP} WHERE NOT retracted AND (list_contains(reached, 'viewed') OR list_contains(reached, 'passed'))", of=record_book)
spec("evt_hours_between", _AP | {"mode": "aggregate", "group_by": [{"field": "status"}], "measures": [{"name": "hours", "agg": "avg_hours_between_events", "event_from": {"kind": "created"}, "event_to": {"kind": "status_changed", "to": ["passed", "rejected"]}}]},
     f"WITH t AS (SELECT entity_id, min(at_us) FILTER (kind = 'created') AS a, min(at_us) FILTER (kind = 'status_changed' AND \"to\" IN ('passed', 'rejected')) AS b FROM {_LOG} WHERE applied AND at_precision = 'time' GROUP BY 1) SELECT status, {cents('avg((b - a) / 3600000000.0)')} AS hours, count(*) AS n FROM {_APP} LEFT JOIN t ON entity_id = id WHERE NOT retracted GROUP BY 1", of=record_book, rounded=("hours",))
spec("evt_order_by_event", _AP | {"mode": "list", "list_fields": ["status"], "order_by_event": {"kind": "status_changed", "to": "rejected"}, "descending": True, "limit": 40},
     f"WITH t AS (SELECT entity_id, max(at_us) AS b FROM {_LOG} WHERE applied AND at_precision = 'time' AND kind = 'status_changed' AND \"to\" = 'rejected' GROUP BY 1) SELECT id, status FROM {_APP} LEFT JOIN t ON entity_id = id WHERE NOT retracted ORDER BY b DESC NULLS LAST, id LIMIT 40", of=record_book)
spec("date_event_substitution", _AP | {"mode": "aggregate", "measures": [{"name": "days", "agg": "avg_days_between", "field": "applied_at", "field_end": "viewed_at"}, {"name": "dated", "agg": "avg", "span": {"start": {"field": "applied_at", "as_dated": True}, "end": {"field": "viewed_at"}}, "unit": "days"}]},
     f"""WITH t AS (SELECT entity_id, min(at_us) FILTER (kind = 'created') AS a, arg_min(local_day, (at_us, seq)) FILTER (kind = 'created') AS ad, min(at_us) FILTER (kind = 'status_changed' AND "to" = 'viewed') AS b,
           arg_min(local_day, (at_us, seq)) FILTER (kind = 'status_changed' AND "to" = 'viewed') AS bd FROM {_LOG} WHERE applied AND at_precision = 'time' GROUP BY 1),
         d AS (SELECT date_diff('day', applied_at, viewed_at) AS dated, CASE WHEN ad = applied_at AND bd = viewed_at THEN (b - a) / 86400000000.0 ELSE date_diff('day', applied_at, viewed_at) END AS days FROM {_APP} LEFT JOIN t ON entity_id = id WHERE NOT retracted)
         SELECT {cents('avg(days)')} AS days, {cents('avg(dated)')} AS dated, count(*) AS n FROM d""", of=record_book, rounded=("days", "dated"))  # fmt: skip

_SE = {"entity_type": "daily", "source": "series"}
spec("series_list_period", _SE | {"mode": "list", "filters": [{"field": "day", "op": "gte", "value": "2024-01-10"}, {"field": "event_type", "op": "eq", "value": ["click", "view"]}], "limit": 500},
     f"SELECT event_type, CAST(day AS VARCHAR) AS day, n, total FROM {_DAILY} WHERE day >= DATE '2024-01-10' AND event_type IN ('click', 'view')", dates=("day",))
whole("series_list_period_matching", _SE | {"mode": "list", "filters": [{"field": "day", "op": "gte", "value": "2024-01-10"}, {"field": "event_type", "op": "eq", "value": ["click", "view"]}]}, ["event_type", "day", "n", "total"],
      ORACLE_SQL["series_list_period"], dates=("day",))
spec("series_month_agg", _SE | {"mode": "aggregate", "group_by": [{"field": "event_type"}, {"field": "day", "bucket": "week"}], "measures": [{"name": "sum_n", "agg": "sum", "field": "n"}, {"name": "days", "agg": "count", "where": [{"field": "n", "op": "gt", "value": 60}]}]},
     f"SELECT event_type, strftime(day, '%Y-W%W') AS day_week, CAST(sum(n) AS BIGINT) AS sum_n, CAST(sum((n > 60)::INT) AS BIGINT) AS days, count(*) AS n FROM {_DAILY} GROUP BY 1, 2")
spec("series_first_last_change", _SE | {"mode": "aggregate", "group_by": [{"field": "event_type"}], "measures": [{"name": a, "agg": a, "field": "total"} for a in ("first", "last", "change", "change_pct")]},
     f"SELECT event_type, {cents('a')} AS first, {cents('z')} AS last, {cents('z - a')} AS change, {cents('(z - a) * 100 / nullif(a, 0)')} AS change_pct, n FROM (SELECT event_type, arg_min(total, day) AS a, arg_max(total, day) AS z, count(*) AS n FROM {_DAILY} GROUP BY 1)", rounded=("first", "last", "change", "change_pct"))
spec("series_ma_points", _SE | {"mode": "list", "window": [{"name": "m7", "measure": "n", "agg": "avg", "size": 7}], "filters": [{"field": "day", "op": "gte", "value": "2024-01-20"}], "list_fields": ["event_type", "day", "m7"], "limit": 1000},
     f"SELECT event_type, CAST(day AS VARCHAR) AS day, {cents('m')} AS m7 FROM (SELECT *, avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS 6 PRECEDING) AS m FROM {_DAILY}) WHERE day >= DATE '2024-01-20'", rounded=("m7",), dates=("day",))
spec("series_ma_days", _SE | {"mode": "list", "window": [{"name": "s5", "measure": "n", "agg": "sum", "size": 5, "unit": "days"}], "list_fields": ["event_type", "day", "s5"], "limit": 1000},
     f"SELECT event_type, CAST(day AS VARCHAR) AS day, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 4 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS s5 FROM {_DAILY}", dates=("day",))
whole("series_ma_points_matching", _SE | {"mode": "list", "window": [{"name": "m7", "measure": "n", "agg": "avg", "size": 7}], "filters": [{"field": "day", "op": "gte", "value": "2024-01-20"}]}, ["event_type", "day", "m7"],
      ORACLE_SQL["series_ma_points"], rounded=("m7",), dates=("day",))
whole("series_ma_days_matching", _SE | {"mode": "list", "window": [{"name": "s5", "measure": "n", "agg": "sum", "size": 5, "unit": "days"}]}, ["event_type", "day", "s5"],
      ORACLE_SQL["series_ma_days"], dates=("day",))
spec("series_below_window", _SE | {"mode": "aggregate", "window": [{"name": "top", "measure": "n", "agg": "max", "size": 5}], "compare": [{"measure": "n", "op": "lt", "baseline": {"window": "top"}}, {"measure": "n", "op": "gt", "baseline": {"value": 10}}], "group_by": [{"field": "event_type"}]},
     f"SELECT event_type, count(*) AS n FROM (SELECT *, max(n) OVER (PARTITION BY event_type ORDER BY day ROWS 4 PRECEDING) AS top FROM {_DAILY}) WHERE n < top AND n > 10 GROUP BY 1")
spec("sum_over_asof", {"entity_type": "line", "mode": "aggregate", "values": [{"name": "close", "asof": {"field": "part_id", "series": "part_price", "measure": "close", "at": "ordered_on"}}, {"name": "worth", "expr": {"op": "mul", "args": ["quantity", "close"]}}], "group_by": [{"field": "flag"}], "measures": [{"name": "worth_sum", "agg": "sum", "field": "worth"}]},
     f"SELECT flag, {cents('sum(quantity * p.close)')} AS worth_sum, count(*) AS n FROM {_LINE} l ASOF LEFT JOIN {_PRICE} p ON l.part_id = p.part_id AND l.ordered_on >= p.day GROUP BY 1", rounded=("worth_sum",))


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


@register("ent_list_total", f"SELECT count(*) AS total FROM {_ORDER} WHERE status = 'O'")
def ent_list_total(spark: SparkSession, d: str) -> DataFrame:
    return ask(book(spark, d), _OR | {"filters": [{"field": "status", "op": "eq", "value": "O"}], "limit": 10}).total


@register("ent_evidence", f"SELECT id, status FROM {_ORDER} WHERE priority = '2-HIGH' AND amount > 4000")
def ent_evidence(spark: SparkSession, d: str) -> DataFrame:
    data = _OR | {"mode": "aggregate", "filters": [{"field": "priority", "op": "eq", "value": "2-HIGH"}, {"field": "amount", "op": "gt", "value": 4000}], "group_by": [{"field": "status"}]}
    return ask(book(spark, d), data).evidence


@register("ent_contains_array", f"SELECT status, count(*) AS n FROM {_APP} WHERE list_contains(reached, 'rejected') GROUP BY 1")
def ent_contains_array(spark: SparkSession, d: str) -> DataFrame:
    b = record_book(spark, d)
    b.types = {"case": TypeDef("case", {"status": FieldDef(), "reached": FieldDef("array")})}
    b.entities = {"case": b.entities["application"].select("id", "status", "reached")}
    return ask(b, {"entity_type": "case", "mode": "aggregate", "filters": [{"field": "reached", "op": "contains", "value": "rejected"}], "group_by": [{"field": "status"}]}).rows


@register("ref_labels_group", f"SELECT customer_id, c_name AS customer_id_label, count(*) AS n FROM {_ORDER} JOIN customer ON c_custkey = customer_id GROUP BY 1, 2")
def ref_labels_group(spark: SparkSession, d: str) -> DataFrame:
    b = book(spark, d)
    return with_labels(ask(b, _OR | {"mode": "aggregate", "group_by": [{"field": "customer_id"}]}).rows, b, "order")


@register("ref_name_filter", f"SELECT count(*) AS n FROM {_ORDER} WHERE customer_id IN (SELECT c_custkey FROM customer WHERE c_name = (SELECT min(c_name) FROM customer))")
def ref_name_filter(spark: SparkSession, d: str) -> DataFrame:
    b = book(spark, d)
    name = b.entities["customer"].agg(F.min("name")).first()[0]
    return ask(b, _OR | {"mode": "count", "filters": [{"field": "customer_id", "op": "name_is", "value": name}]}).rows


@register("id_anti_check", "SELECT x.id FROM (VALUES (1), (2), (-5), (999999999)) x(id) WHERE x.id NOT IN (SELECT c_custkey FROM customer)")
def id_anti_check(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([(1,), (2,), (-5,), (999_999_999,)], "id int")
    return asked.join(table(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("id")), "id", "left_anti")


@register("identity_cascade")
def identity_cascade(spark: SparkSession, d: str) -> DataFrame:
    return identify(table(spark, d, "resolutions"), table(spark, d, "companies"))


@register("asof_last_view", """
SELECT p.event_id, CAST(v.ts AS VARCHAR) AS viewed FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")  # fmt: skip
def asof_last_view(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    views = e.where("event_type = 'view'").select("user_id", "us")
    day = 86_400_000_000
    out = asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "us"), views, F.col("user_id"), F.col("us"), F.col("user_id"), F.col("us"), F.col("us"), "seen", block=7 * day)
    return out.select("event_id", F.timestamp_micros("seen").cast("timestamp_ntz").cast("string").alias("viewed"))


@register("asof_part_price_value", f"""
SELECT count(*) FILTER (close IS NULL) AS none, CAST(count(*) FILTER (date_diff('day', day, DATE '1997-06-30') > 7) AS BIGINT) AS old, CAST(min(day) AS VARCHAR) AS oldest
FROM (SELECT *, DATE '1997-06-30' AS asked FROM {_LINE}) l ASOF LEFT JOIN {_PRICE} p ON l.part_id = p.part_id AND l.asked >= p.day""")  # fmt: skip
def asof_part_price_value(spark: SparkSession, d: str) -> DataFrame:
    at = dt.date(1997, 6, 30)
    data = {"entity_type": "line", "mode": "list", "values": [{"name": "close", "asof": {"field": "part_id", "series": "part_price", "measure": "close", "at": at.isoformat()}}]}
    return diag.asof_gaps(ask(book(spark, d), data), "close", at).withColumn("oldest", F.col("oldest").cast("string"))


@register("diag_missing_fields", f"SELECT 'priority' AS field, count(*) AS missing FROM {_ORDER} WHERE priority IS NULL")
def diag_missing_fields(spark: SparkSession, d: str) -> DataFrame:
    return diag.missing_fields(book(spark, d), parse(_OR | {"mode": "aggregate", "filters": [{"field": "status", "op": "eq", "value": "O"}], "group_by": [{"field": "priority"}]}))


@register("diag_small_incomplete", f"SELECT strftime(ordered_on, '%Y-%m') AS ordered_on_month, count(*) AS n FROM {_ORDER} WHERE strftime(ordered_on, '%Y-%m') = '2001-07' GROUP BY 1 UNION ALL SELECT strftime(ordered_on, '%Y-%m-%d'), count(*) FROM {_ORDER} GROUP BY 1 HAVING count(*) < 5")
def diag_small_incomplete(spark: SparkSession, d: str) -> DataFrame:
    b = book(spark, d)
    month = parse(_OR | {"mode": "aggregate", "group_by": [{"field": "ordered_on", "bucket": "month"}]})
    day = _OR | {"mode": "aggregate", "group_by": [{"field": "ordered_on", "bucket": "day"}]}
    return diag.incomplete_periods(ask(b, month), month, dt.date(2001, 7, 20)).unionByName(diag.small_groups(ask(b, day)).withColumnRenamed("ordered_on_day", "ordered_on_month"))


@register("diag_inexact_times", f"SELECT count(DISTINCT entity_id) AS records FROM {_LOG} WHERE at_precision <> 'time'")
def diag_inexact_times(spark: SparkSession, d: str) -> DataFrame:
    return diag.inexact_times(record_book(spark, d), "application")


@register("diag_reached_without_time", f"SELECT id FROM {_APP} WHERE list_contains(reached, 'viewed') AND id NOT IN (SELECT entity_id FROM {_LOG} WHERE applied AND at_precision = 'time' AND \"to\" = 'viewed')")
def diag_reached_without_time(spark: SparkSession, d: str) -> DataFrame:
    return diag.reached_without_time(record_book(spark, d), "application", "viewed")


@register("diag_dated_spans", f"""
WITH t AS (SELECT entity_id, arg_min(local_day, (at_us, seq)) FILTER (kind = 'created') AS ad, arg_min(local_day, (at_us, seq)) FILTER (kind = 'status_changed' AND "to" = 'viewed') AS bd FROM {_LOG} WHERE applied AND at_precision = 'time' GROUP BY 1)
SELECT CAST(sum((applied_at IS NOT NULL AND viewed_at IS NOT NULL AND NOT coalesce(ad = applied_at AND bd = viewed_at, false))::INT) AS BIGINT) AS dated_0 FROM {_APP} LEFT JOIN t ON entity_id = id WHERE NOT retracted""")  # fmt: skip
def diag_dated_spans(spark: SparkSession, d: str) -> DataFrame:
    planner = Planner(record_book(spark, d), _AP | {"mode": "aggregate", "measures": [{"name": "days", "agg": "avg_days_between", "field": "applied_at", "field_end": "viewed_at"}]})
    return diag.dated_spans(planner.answer(), planner)


@register("fold_reached", replay_sql(FIRST_RECORDINGS) + "SELECT entity_id, string_agg(v, ',' ORDER BY a) AS reached FROM (SELECT entity_id, v, min(ord) AS a FROM said WHERE field = 'status' AND v IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def fold_reached(spark: SparkSession, d: str) -> DataFrame:
    return history.statuses_reached(table(spark, d, "record_events")).withColumn("reached", F.array_join("reached", ","))


@register("fold_times", replay_sql(FIRST_RECORDINGS) + "SELECT entity_id, min(at_us) FILTER (kind = 'created') AS created_us, max(at_us) AS updated_us, count(*) AS n_applied FROM data GROUP BY 1")
def fold_times(spark: SparkSession, d: str) -> DataFrame:
    return history.record_times(table(spark, d, "record_events"))


def _batches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A current series and a batch with new, changed and equal points (by type and day)."""
    points = book(spark, d).series["daily"].select("event_type", "day", "n")
    current = points.where(F.dayofmonth("day") <= 20).withColumn("batch_id", F.lit("b1"))
    batch = points.where(F.dayofmonth("day") >= 15).withColumn("n", F.when(F.dayofmonth("day") % 2 == 0, F.col("n") + 1).otherwise(F.col("n")))
    return current, batch


_BATCH = f"SELECT event_type, day, n + (CASE WHEN day(day) % 2 = 0 THEN 1 ELSE 0 END) AS n FROM {_DAILY} WHERE day(day) >= 15"


@register("series_batch_classify", f"SELECT event_type, CAST(day AS VARCHAR) AS day, CASE WHEN day(day) > 20 THEN 'inserted' WHEN day(day) % 2 = 0 THEN 'updated' ELSE 'unchanged' END AS action FROM ({_BATCH})")
def series_batch_classify(spark: SparkSession, d: str) -> DataFrame:
    return series.classify(*_batches(spark, d), ["event_type", "day"]).select("event_type", F.col("day").cast("string").alias("day"), "action")


@register("series_batch_merge", f"SELECT event_type, CAST(day AS VARCHAR) AS day, n, 'b1' AS batch_id FROM {_DAILY} WHERE day(day) < 15 OR (day(day) <= 20 AND day(day) % 2 = 1) UNION ALL SELECT event_type, CAST(day AS VARCHAR), n, 'b2' FROM ({_BATCH}) WHERE day(day) > 20 OR day(day) % 2 = 0")
def series_batch_merge(spark: SparkSession, d: str) -> DataFrame:
    return series.merge(*_batches(spark, d), ["event_type", "day"], "b2").withColumn("day", F.col("day").cast("string"))


@register("series_batch_revert", f"SELECT event_type, CAST(day AS VARCHAR) AS day, n, 'b1' AS batch_id FROM {_DAILY} WHERE day(day) <= 20")
def series_batch_revert(spark: SparkSession, d: str) -> DataFrame:
    current, batch = _batches(spark, d)
    keys = ["event_type", "day"]
    changes = series.classify(current, batch, keys)
    return series.revert(series.merge(current, batch, keys, "b2"), changes, keys, "b2").withColumn("day", F.col("day").cast("string"))


@register("series_gap_days", f"SELECT event_type, count(*) AS points, CAST(date_diff('day', min(day), max(day)) + 1 AS BIGINT) AS expected, CAST(date_diff('day', min(day), max(day)) + 1 - count(*) AS BIGINT) AS missing FROM {_DAILY} WHERE n % 3 <> 0 GROUP BY 1")
def series_gap_days(spark: SparkSession, d: str) -> DataFrame:
    return series.gaps(book(spark, d).series["daily"].where("n % 3 <> 0"), ["event_type"], "day")


_SOURCE = "(SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders WHERE o_orderkey % 17 <> 0)"
_STATE = "(SELECT o_orderkey AS k, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderkey % 19 <> 0)"


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    source = o.where("k % 17 <> 0").select("k", F.expr("CASE WHEN k % 11 = 0 THEN 'X' ELSE status END").alias("status"), F.expr("CASE WHEN k % 13 = 0 THEN NULL ELSE priority END").alias("priority"))
    return source, o.where("k % 19 <> 0")


@register("import_diff", f"""
SELECT n.k, CASE WHEN s.k IS NULL THEN 'created' WHEN n.status IS NOT DISTINCT FROM s.status AND n.priority IS NOT DISTINCT FROM s.priority THEN 'unchanged' ELSE 'updated' END AS action,
  CASE WHEN s.k IS NULL THEN '' ELSE concat_ws(',', CASE WHEN n.priority IS DISTINCT FROM s.priority THEN 'priority' END, CASE WHEN n.status IS DISTINCT FROM s.status THEN 'status' END) END AS changed
FROM {_SOURCE} n LEFT JOIN {_STATE} s USING (k)""")  # fmt: skip
def import_diff(spark: SparkSession, d: str) -> DataFrame:
    return imports.difference(*_snapshots(spark, d), "k")


@register("import_vanished", f"SELECT k FROM {_STATE} WHERE k NOT IN (SELECT k FROM {_SOURCE})")
def import_vanished(spark: SparkSession, d: str) -> DataFrame:
    return imports.vanished(*_snapshots(spark, d), "k")


@register("combine_sources", f"SELECT k, coalesce(a.status, b.status) AS status, CAST((a.status IS NOT NULL)::INT + (b.status IS NOT NULL)::INT AS BIGINT) AS present, a.status IS DISTINCT FROM b.status AS mismatch FROM {_SOURCE} a FULL JOIN {_STATE} b USING (k)")
def combine_sources(spark: SparkSession, d: str) -> DataFrame:
    return imports.combine(*_snapshots(spark, d), "k", "status", "first")


@register("drafts_infer_keys", """
SELECT event_type, field, CASE WHEN t = 'BIGINT' OR t = 'UBIGINT' THEN 'integer' WHEN t = 'VARCHAR' THEN 'string' ELSE lower(t) END AS json_type, count(*) AS n
FROM (SELECT event_type, field, json_type(json_extract(props, '$.' || field)) AS t FROM (SELECT event_type, props, unnest(json_keys(props)) AS field FROM events)) GROUP BY 1, 2, 3""")  # fmt: skip
def drafts_infer_keys(spark: SparkSession, d: str) -> DataFrame:
    return profile.field_types(table(spark, d, "events"), "event_type", "props")


@register("unknown_field_stats", "SELECT entity_type, field, count(*) AS n, min(seen_at) AS first_seen, max(seen_at) AS last_seen, count(DISTINCT recorded_by) AS recorders FROM schema_observations GROUP BY 1, 2")
def unknown_field_stats(spark: SparkSession, d: str) -> DataFrame:
    return profile.unknown_fields(table(spark, d, "schema_observations")).drop("samples")


@register("observed_values", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def observed_values(spark: SparkSession, d: str) -> DataFrame:
    return profile.observed_values(table(spark, d, "orders"), "o_orderpriority")


@register("kind_signals", f"SELECT 'event_type' AS keys, max(c) = 1 AS is_key, median(r) AS median_rows, max(c) = 1 AND median(r) >= 5 AS is_series FROM (SELECT count(*) AS r, 1 AS c FROM {_DAILY} GROUP BY event_type) UNION ALL SELECT '', false, CAST(count(*) AS DOUBLE), false FROM {_DAILY}")
def kind_signals(spark: SparkSession, d: str) -> DataFrame:
    return profile.series_signals(book(spark, d).series["daily"], "day", ["event_type"])


@register("text_split_chunks")
def text_split_chunks(spark: SparkSession, d: str) -> DataFrame:
    return text.split_documents(table(spark, d, "documents"))


@register("text_numbers_evidence", r"SELECT doc_id, list_contains(list_transform(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?'), lambda x: CAST(replace(x, ',', '') AS DOUBLE)), 404.0) OR list_contains(list_transform(regexp_extract_all(text, '(\d+(?:\.\d+)?)\s*만', 1), lambda x: CAST(x AS DOUBLE) * 1e4), 404.0) OR list_contains(list_transform(regexp_extract_all(text, '(\d+(?:\.\d+)?)\s*억', 1), lambda x: CAST(x AS DOUBLE) * 1e8), 404.0) AS found FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL")
def text_numbers_evidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.number_in_quote(F.lit(404.0), F.col("text")).alias("found"))


_FACTS = "(SELECT o_custkey AS who, o_orderstatus AS status, CAST(o_orderkey AS VARCHAR) AS span_id FROM orders)"


@register("text_merge_conflicts", f"SELECT who, string_agg(DISTINCT status, '|' ORDER BY status) AS status, count(DISTINCT span_id) AS spans, count(DISTINCT status) > 1 AS conflict FROM {_FACTS} GROUP BY 1")
def text_merge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "orders").select(F.col("o_custkey").alias("who"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").cast("string").alias("span_id"))
    return text.merged_facts(facts, ["who"], ["status"])


@register("siblings_pairs", "SELECT DISTINCT a.l_partkey AS id, b.l_partkey AS other FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey <> b.l_partkey")
def siblings_pairs(spark: SparkSession, d: str) -> DataFrame:
    return text.siblings(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("span_id"), F.col("l_partkey").alias("id")))


_QLOG = "(SELECT event_id AS id, event_type AS path, CASE WHEN event_type = 'error' THEN 'failed' END AS error, event_id % 29 = 0 AS diverging, CAST(event_id % 1000 AS BIGINT) AS size FROM events)"


def _query_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("path"), F.when(F.col("event_type") == "error", "failed").alias("error"), (F.col("event_id") % 29 == 0).alias("diverging"), (F.col("event_id") % 1000).alias("size")
    )


@register("log_views", f"SELECT * FROM {_QLOG} WHERE error IS NOT NULL ORDER BY id DESC LIMIT 25")
def log_views(spark: SparkSession, d: str) -> DataFrame:
    return querylog.view(_query_log(spark, d), "errors", 25)


@register("log_by_path", f"SELECT path, count(*) AS n FROM {_QLOG} GROUP BY 1")
def log_by_path(spark: SparkSession, d: str) -> DataFrame:
    return querylog.by_path(_query_log(spark, d))


@register("log_retention", f"""
WITH s AS (SELECT *, count(*) OVER (ORDER BY id DESC) AS r FROM {_QLOG} WHERE error IS NOT NULL OR diverging), kept AS (SELECT id, path, error, diverging, size FROM s WHERE r <= 200),
 u AS (SELECT count(*) AS n, sum(size) AS b FROM kept),
 o AS (SELECT *, count(*) OVER (ORDER BY id DESC) AS r, sum(size) OVER (ORDER BY id DESC) AS z FROM {_QLOG} WHERE error IS NULL AND NOT diverging)
SELECT * FROM kept UNION ALL SELECT id, path, error, diverging, size FROM o, u WHERE r <= 900 - u.n AND z <= 450000 - u.b""")  # fmt: skip
def log_retention(spark: SparkSession, d: str) -> DataFrame:
    return querylog.retained(_query_log(spark, d), 1000, 500_000)


@register("view_flat_orders", f"SELECT CAST(id AS VARCHAR) AS id, CASE status WHEN 'F' THEN 'finished' ELSE status END AS status, CAST(ordered_on AS VARCHAR) AS ordered_on, priority, CAST(amount AS VARCHAR) AS amount, c_name AS customer, c_name AS label FROM {_ORDER} JOIN customer ON c_custkey = customer_id")
def view_flat_orders(spark: SparkSession, d: str) -> DataFrame:
    b = book(spark, d)
    order = TYPES["order"].fields
    b.types = {"order": TypeDef("order", {n: FieldDef(enum=order[n].enum, labels={"F": ["finished"]}) if n == "status" else order[n] for n in order})}
    return flat_view(b, "order")
