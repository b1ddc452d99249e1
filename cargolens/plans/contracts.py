"""Registered source, sink and contract queries."""

import uuid

from pyspark.sql import functions as F

from ..functions.scale import use_checkpoint_dir
from ..operators import calendar as C, contracts as K
from ..sources import bindings as B, tables as S
from .registry import register, view

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
REQUIRED = {"orders": ["o_orderkey", "o_custkey", "o_orderdate"], "lineitem": ["l_orderkey", "l_quantity"],
            "events": ["event_id", "ts", "user_id"], "pages": ["page_id", "url", "html"]}


def _read_all(spark, folder):
    out = None
    for name in TABLES:
        df = S.read_table(spark, f"{folder}/{name}.parquet", required=REQUIRED.get(name), fmt="parquet")
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def _written(spark, folder):
    use_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"
    S.write_table(B.demand(spark, folder), path, "csv")
    return S.read_table(spark, path, S.SCHEMAS["demand"])


def _digest(spark, folder):
    return S.file_digest(spark, folder, "*.parquet")


def _manifest(spark, folder):
    """The folder's own digests with one file left out and one digest replaced."""
    actual = _digest(spark, folder)
    recorded = actual.where(F.col("file") != "region.parquet").select(
        "file", F.when(F.col("file") == "nation.parquet", F.sha2("file", 256)).otherwise(F.col("sha256")).alias("sha256"),
        F.lit("input_sha256").alias("digest_group"))
    return S.manifest_diff(recorded, actual, ["input_sha256", "result_sha256"])


register("read_table", "table:s rows:i", _read_all,
         " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in TABLES))
register("write_table", "date:d region:s sku:s quantity:f", _written, "SELECT * FROM dm_demand")
register("file_digest", "file:s bytes:i sha256:s", _digest)
register("manifest_diff", "file:s digest_group:s status:s", _manifest)

view("dl_clicks", """
SELECT event_id AS order_id, strftime(ts, '%-m%d') AS ds, date_trunc('second', ts) AS accept_time,
  date_trunc('second', bought) AS delivery_time FROM (
  SELECT *, min(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts
    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS bought
  FROM events WHERE event_type IN ('click', 'purchase')) WHERE event_type = 'click'""")

register("null_audit", "column:s nulls:i", lambda s, d: K.null_audit(B.click_to_purchase(s, d)), """
SELECT 'delivery_time' AS "column", count(*) AS nulls FROM dl_clicks WHERE delivery_time IS NULL HAVING count(*) > 0""")
register("dup_keys", "l_orderkey:i l_partkey:i n:i",
         lambda s, d: K.dup_keys(B.table(s, d, "lineitem"), ["l_orderkey", "l_partkey"]), """
SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
register("sign_check", "c_custkey:i c_acctbal:f",
         lambda s, d: K.sign_check(B.table(s, d, "customer"), "c_acctbal", strict=True),
         "SELECT * FROM customer WHERE c_acctbal <= 0")
_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
register("finite_check", "column:s finite:i not_finite:i",
         lambda s, d: K.finite_audit(B.table(s, d, "lineitem"), _NUMBERS),
         " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (isfinite({c})) AS finite, "
                            f"count(*) FILTER (NOT isfinite({c})) AS not_finite FROM lineitem" for c in _NUMBERS))
register("calendar_gaps", "series_id:s date:d", lambda s, d: C.calendar_gaps(B.regional_daily(s, d)), """
SELECT c.series_id, c.date FROM (SELECT series_id, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date
  FROM dm_daily GROUP BY series_id) c ANTI JOIN dm_daily d ON c.series_id = d.series_id AND c.date = d.date""")
view("wb_waybills", """
SELECT o_custkey AS customer_id, o_orderkey AS waybill_id, CAST(o_orderdate AS DATE) AS date, sum(l_quantity) AS quantity
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3""")
register("before_cutoff", "waybill_id:i date:d quantity:f",
         lambda s, d: K.before_cutoff(B.waybills(s, d), "1998-01-01"),
         "SELECT * FROM wb_waybills WHERE date < DATE '1998-01-01'")
register("after_cutoff", "waybill_id:i date:d quantity:f",
         lambda s, d: K.after_cutoff(B.waybills(s, d), "1998-01-01"),
         "SELECT * FROM wb_waybills WHERE date >= DATE '1998-01-01'")
register("history_reaches_origin", "series_id:s last_date:d expected_date:d reaches:b",
         lambda s, d: K.history_reaches_origin(B.regional_daily(s, d), "2001-06-01"), """
SELECT series_id, max(date) AS last_date, DATE '2001-05-31' AS expected_date, max(date) = DATE '2001-05-31' AS reaches
FROM dm_daily WHERE date < DATE '2001-06-01' GROUP BY series_id""")


def _latest(spark, folder):
    ev = B.table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type", "value")
    asks = ev.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("prediction_at"))
    facts = ev.where("event_type = 'view'").select("user_id", F.col("ts").alias("available_at"), "value")
    return K.latest_known(asks, facts, "user_id", "prediction_at", "available_at", "value")


register("point_in_time", "event_id:i user_id:i prediction_at:t available_at:t value:f", _latest, """
SELECT p.event_id, p.user_id, p.ts AS prediction_at, v.ts AS available_at, v.value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
register("available_features", "order_id:i line:i accept_time:d delivery_time:d",
         lambda s, d: K.point_in_time(B.order_shipments(s, d), "delivery_time", "accept_time"), """
SELECT l_orderkey AS order_id, l_linenumber AS line, o_orderdate AS accept_time, l_shipdate AS delivery_time
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate <= o_orderdate""")
register("late_features", "order_id:i line:i accept_time:d delivery_time:d",
         lambda s, d: K.late_features(B.order_shipments(s, d), "delivery_time", "accept_time"), """
SELECT l_orderkey AS order_id, l_linenumber AS line, o_orderdate AS accept_time, l_shipdate AS delivery_time
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate""")


def _folds(spark, folder):
    lines = B.table(spark, folder, "lineitem").select("l_returnflag", F.to_date("l_shipdate").alias("date"))
    by_date = F.when(F.col("date") < F.lit("1999-01-01").cast("date"), "train").otherwise("valid")
    by_flag = F.when(F.col("l_returnflag") == "A", "train").otherwise("valid")
    rows = lines.select("date", F.inline(F.array(
        F.struct(F.lit("by_date").alias("fold"), by_date.alias("role")),
        F.struct(F.lit("by_flag").alias("fold"), by_flag.alias("role")))))
    return K.future_split_check(rows)


register("future_split_check", "fold:s train_end:d valid_start:d ok:b", _folds, """
SELECT fold, max(date) FILTER (role = 'train') AS train_end, min(date) FILTER (role = 'valid') AS valid_start,
  max(date) FILTER (role = 'train') < min(date) FILTER (role = 'valid') AS ok
FROM (SELECT 'by_date' AS fold, CAST(l_shipdate AS DATE) AS date,
        CASE WHEN l_shipdate < DATE '1999-01-01' THEN 'train' ELSE 'valid' END AS role FROM lineitem
      UNION ALL SELECT 'by_flag', CAST(l_shipdate AS DATE),
        CASE WHEN l_returnflag = 'A' THEN 'train' ELSE 'valid' END FROM lineitem) GROUP BY fold""")


def _keys(spark, folder):
    orders = B.table(spark, folder, "orders").select(F.col("o_orderkey").alias("order_id"))
    lines = B.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("order_id"))
    return orders, lines


register("join_cardinality", "side:s order_id:i n:i",
         lambda s, d: K.join_cardinality(*_keys(s, d), ["order_id"]), """
SELECT 'left' AS side, o_orderkey AS order_id, count(*) AS n FROM orders GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'right', l_orderkey, count(*) FROM lineitem GROUP BY 2 HAVING count(*) > 1""")
register("key_set_equal", "order_id:i status:s", lambda s, d: K.key_set_equal(*_keys(s, d), ["order_id"]), """
SELECT o_orderkey AS order_id, 'left_only' AS status FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey
UNION ALL SELECT DISTINCT l_orderkey, 'right_only' FROM lineitem ANTI JOIN orders ON o_orderkey = l_orderkey""")


def _amounts(spark, folder):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    lines = B.table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sum(net).alias("line_amount"))
    orders = B.table(spark, folder, "orders").select(F.col("o_orderkey").alias("order_id"), "o_totalprice")
    return orders.join(lines, F.col("order_id") == F.col("l_orderkey"))


register("allclose_check", "order_id:i o_totalprice:f line_amount:f",
         lambda s, d: K.allclose_check(_amounts(s, d), "o_totalprice", "line_amount"), """
SELECT * FROM (
  SELECT o_orderkey AS order_id, o_totalprice, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS line_amount
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
WHERE NOT abs(o_totalprice - line_amount) <= 1e-8 + 1e-5 * abs(line_amount)""")
register("rows_vs_distinct", "date:d order_id:i row_count:i distinct_count:i",
         lambda s, d: K.rows_vs_distinct(B.warehouse_orders(s, d), ["date", "order_id"], "sku"), """
SELECT date, order_id, count(*) AS row_count, count(DISTINCT sku) AS distinct_count FROM wh_orders
GROUP BY date, order_id HAVING count(*) <> count(DISTINCT sku)""")


def _candidates(spark, folder):
    lines = B.table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("label"), F.sum("l_quantity").alias("shipped_quantity"),
        (F.count(F.lit(1)) * 25.0).alias("lines_times_25"))
    orders = B.table(spark, folder, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("price_k"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


register("answer_as_feature", "candidate:s mae:f copies_answer:b",
         lambda s, d: K.answer_as_feature(_candidates(s, d), "label", ["shipped_quantity", "lines_times_25", "price_k"]),
         """
SELECT candidate, avg(abs(label - guess)) AS mae, avg(abs(label - guess)) = 0 AS copies_answer FROM (
  SELECT *, avg(label) OVER () AS constant FROM (
    SELECT l_orderkey, sum(l_quantity) AS label, count(*) * 25.0 AS n25, any_value(o_totalprice) / 1000 AS price
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey)) b,
  LATERAL (VALUES ('shipped_quantity', label), ('lines_times_25', CAST(n25 AS DOUBLE)), ('price_k', price),
           ('constant_mean', constant)) v(candidate, guess) GROUP BY candidate""")


def _catalog(spark, folder):
    return B.table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("competition"), F.col("lang").alias("priority"),
        F.col("source").alias("title"), F.col("text").alias("value"), F.col("lang").alias("limitation"))


register("catalog_search", "id:i competition:s priority:s",
         lambda s, d: K.catalog_search(_catalog(s, d), "src1", "And The", "en"), """
SELECT doc_id AS id, source AS competition, lang AS priority FROM documents
WHERE contains(source, 'src1') AND lang = 'en'
  AND contains(lower(concat_ws(' ', source, text, lang)), 'and the')""")


def _page_catalog(spark, folder):
    """Pages as catalogue entries: title from the page, priority and check date from the id."""
    n = F.col("page_id")
    return B.table(spark, folder, "pages").select(
        n.cast("string").alias("id"), F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
        F.col("url").alias("url"), F.concat(F.lit("P"), (n % 4).cast("string")).alias("priority"),
        F.concat(F.lit("2024-02-"), F.lpad((n % 33).cast("string"), 2, "0")).alias("checked_at"))


view("ct_pages", """
SELECT CAST(page_id AS VARCHAR) AS id, coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, url,
  'P' || (page_id % 4) AS priority, '2024-02-' || lpad(CAST(page_id % 33 AS VARCHAR), 2, '0') AS checked_at FROM pages""")
view("ct_full", """
SELECT *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host
FROM ct_pages WHERE trim(title) <> '' AND trim(url) <> ''""")
register("catalog_quality", "id:s rule:s field:s",
         lambda s, d: K.catalog_quality(_page_catalog(s, d), ["id", "title", "url", "priority", "checked_at"]), """
SELECT id, 'blank' AS rule, 'title' AS field FROM ct_pages WHERE trim(title) = ''
UNION ALL SELECT id, 'blank', 'url' FROM ct_pages WHERE trim(url) = ''
UNION ALL SELECT id, 'priority', 'priority' FROM ct_full WHERE priority NOT IN ('P0', 'P1', 'P2')
UNION ALL SELECT id, 'url_scheme_or_host', 'url' FROM ct_full WHERE scheme NOT IN ('http', 'https') OR host = ''
UNION ALL SELECT id, 'url_reserved_host', 'url' FROM ct_full
  WHERE scheme IN ('http', 'https') AND host LIKE '%.invalid'
UNION ALL SELECT id, 'date', 'checked_at' FROM ct_full WHERE try_cast(checked_at AS DATE) IS NULL
UNION ALL SELECT id, 'duplicate', 'id' FROM ct_full WHERE id IN (SELECT id FROM ct_full GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT id, 'duplicate', 'url' FROM ct_full WHERE url IN (SELECT url FROM ct_full GROUP BY url HAVING count(*) > 1)""")
