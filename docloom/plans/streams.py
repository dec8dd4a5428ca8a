"""Queries of the batch twins of streaming operators over events, with SQL, and of user extensions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import strategies, udf
from docloom.operators import extract
from docloom.plans.registry import Group
from docloom.streaming import devices as D
from docloom.streaming import events as E
from docloom.streaming import quotas as K

G = Group()
NOW = 1_704_067_200 + 15 * 86_400


def keyed(e: DataFrame) -> DataFrame:
    return e.select(F.col("user_id").cast("string").alias("key"), "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), (F.col("event_id") % 3 + 1).alias("cost"))


G.add("k1_sliding_quota", "events", lambda e: K.admit(keyed(e), K.sliding_quota(3, 2 * 86_400)))
G.add("k2_multi_bucket_quota", "events", lambda e: K.admit(keyed(e), K.multi_bucket_quota({"day": (6, 86_400), "week": (20, 7 * 86_400)})))
G.add("k3_lease_limit", "events", lambda e: K.admit(keyed(e).withColumn("cost", F.when(F.col("cost") == 3, -1).otherwise(1)), K.lease_limit(2, 5 * 86_400)))
G.add("k4_device_binding", "events", lambda e: D.bind(keyed(e).withColumn("device", F.col("event_id") * 7 % 61), 3, 10 * 86_400)[0])
G.add("k5_replay_fresh", "events", lambda e: E.replay_fresh(keyed(e), "ts", F.lit(NOW), 5 * 86_400).where(F.col("ts") <= NOW).select("event_id"), f"SELECT event_id FROM events WHERE floor(epoch(ts)) > {NOW} - 5 * 86400 AND floor(epoch(ts)) <= {NOW}")
G.add("k6_connection_counts", "events", lambda e: K.admit(keyed(e), K.connection_counts(3 * 86_400)))


def repeated(e: DataFrame) -> DataFrame:
    return e.unionByName(e.where("event_id % 50 = 0")).select(F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("event_key"), "event_id")


G.add("k7_idempotent_ingest", "events", lambda e: E.idempotent(repeated(e), ["event_key"], "event_id"), "SELECT event_type || ':' || event_id AS event_key, event_id FROM events")
G.add("k8_reject_stale", "events", lambda e: E.reject_stale(keyed(e).withColumn("arrival", F.col("event_id") * 7 % 1009 * 1_000_000 + F.col("event_id")), "key", "arrival", "ts").select("event_id"),
      "SELECT event_id FROM (SELECT event_id, s, max(s) OVER (PARTITION BY user_id ORDER BY event_id * 7 % 1009 * 1000000 + event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)) WHERE m IS NULL OR s >= m")
G.add("k9_ordered_outbox", "outbox", lambda o: E.eligible(o, F.lit(NOW)).select("id", "aggregate_id"),
      f"SELECT id, aggregate_id FROM (SELECT *, min(id) OVER (PARTITION BY aggregate_id) AS f FROM outbox WHERE status = 'pending') WHERE id = f AND available_s <= {NOW} AND (locked_s IS NULL OR locked_s < {NOW} - 300)")
G.add("k10_retry_or_dead_letter", "outbox", lambda o: E.retry_or_dead_letter(o, F.lit(NOW)).select("id", "new_status", "available_again_s"),
      f"SELECT id, CASE WHEN attempts + 1 >= 5 THEN 'dead' ELSE 'pending' END AS new_status, CASE WHEN attempts + 1 < 5 THEN {NOW} + CAST(least(pow(2, least(attempts, 8)), 300) AS BIGINT) END AS available_again_s FROM outbox")
G.add("k11_monotone_read_mark", "events", lambda e: E.read_marks(e.select(F.col("user_id"), (F.col("event_id") * 31 % 997).alias("mark")), ["user_id"], "mark"), "SELECT user_id, max(event_id * 31 % 997) AS mark FROM events GROUP BY 1")
G.add("k12_notification_claim", "outbox", lambda o: E.claim(o, F.lit(NOW), 40).select("id"), f"SELECT id FROM outbox WHERE status = 'pending' AND available_s <= {NOW} AND (locked_s IS NULL OR locked_s < {NOW} - 300) ORDER BY id LIMIT 40")


def own_class(d: DataFrame) -> DataFrame:
    udf.register_extraction_class("order_slip", {"customer": [r"customer\s*[:\-]?\s*(C\d+)"]})
    return extract.class_fields(d, "order_slip").select("doc_id", "value")


def codes(text: str):
    return [(m.start(), m.end(), m[0], "order_code", "user") for m in re.finditer(r"INV-\d+", text)]


def own_detector(d: DataFrame) -> DataFrame:
    udf.register_detector("codes", codes)
    return udf.detect_with(d, "codes").select("doc_id", "quote")


def own_model(d: DataFrame) -> DataFrame:
    udf.register_text_model("first_line", lambda t: t.split("\n")[0])
    return udf.write_with(d, "first_line", lambda s, o: bool(o)).select("doc_id", "output")


G.add("v1_register_extraction_class", "record_text", own_class, r"SELECT doc_id, regexp_extract(text, 'Customer: (C\d+)', 1) AS value FROM record_text")


def order_lines(text: str, lines: list[str], wanted: frozenset[str]) -> strategies.Extraction:
    """Customer and total of an order, its items as rows, and a warning where two totals differ."""
    found, totals = strategies.Extraction(), set()
    for n, line in enumerate(lines, 1):
        if m := re.match(r"(Customer|Total): (\S+)", line):
            found.fields += [] if m[1] == "Total" and totals else [(m[1].lower(), m[2], 0.9, n)]
            totals |= {m[2]} if m[1] == "Total" else set()
        elif m := re.match(r"(bolt|nut)\t(\d+)\t", line):
            found.rows.append((n, {"item": m[1], "quantity": m[2]}))
    if len(totals) > 1:
        found.warnings.append("totals differ")
    return found


def own_strategy(d: DataFrame) -> DataFrame:
    strategies.register_strategy("order_lines", order_lines)
    return strategies.extract_with(d, "order_lines").select("doc_id", "kind", "name", "value", "row_index", F.col("record")["item"].alias("item"), "warning")


G.add("v1_strategy", "record_text", own_strategy,
      r"""SELECT doc_id, 'field' AS kind, unnest(['customer', 'total']) AS name, unnest([regexp_extract(text, 'Customer: (\S+)', 1), regexp_extract(text, 'Total: (\S+)', 1)]) AS value, NULL::INTEGER AS row_index, NULL AS item, NULL AS warning FROM record_text
      UNION ALL SELECT doc_id, 'row', NULL, NULL, unnest([1, 2]), unnest(['bolt', 'nut']), NULL FROM record_text
      UNION ALL SELECT doc_id, 'warning', NULL, NULL, NULL, NULL, 'totals differ' FROM record_text WHERE doc_id % 2 = 1""")
G.add("v2_register_detector", "record_text", own_detector, r"SELECT doc_id, regexp_extract(text, 'INV-\d+') AS quote FROM record_text")
G.add("v3_register_text_model", "record_text", own_model, "SELECT doc_id, split_part(text, chr(10), 1) AS output FROM record_text")
