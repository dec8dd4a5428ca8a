"""Queries over messages, members, calls and files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import relational as R
from docloom.operators import search as S
from docloom.operators.business import plan_rank
from docloom.plans.registry import Group

G = Group()
SHA = "sha2(canonical, 256)"

# Joins

G.add("j1_inner_equi", "messages rooms", lambda m, r: m.join(r.select(F.col("id").alias("conversation_id"), "type"), "conversation_id").select("id", "conversation_id", "type"),
      "SELECT m.id, m.conversation_id, r.type FROM messages m JOIN rooms r ON r.id = m.conversation_id")
G.add("j2_left_equi", "messages read_state", lambda m, r: m.join(r, (m["conversation_id"] == r["conversation_id"]) & (m["sender_user_id"] == r["user_id"]), "left").select(m["id"], r["last_read_message_id"]),
      "SELECT m.id, r.last_read_message_id FROM messages m LEFT JOIN read_state r ON r.conversation_id = m.conversation_id AND r.user_id = m.sender_user_id")
G.add("j3_left_semi", "conversation_members call_participants", lambda m, p: m.join(p.where("status = 'joined'"), ["user_id", "organization_id"], "left_semi").select("conversation_id", "user_id"),
      "SELECT conversation_id, user_id FROM conversation_members m WHERE EXISTS (SELECT 1 FROM call_participants p WHERE p.status = 'joined' AND p.user_id = m.user_id AND p.organization_id = m.organization_id)")
G.add("j4_left_anti", "subscriptions collection_jobs", lambda s, j: s.join(j.where("purpose = 'renewal'").select(F.col("account_id").alias("id")), "id", "left_anti").select("id", "user_id"),
      "SELECT id, user_id FROM subscriptions s WHERE NOT EXISTS (SELECT 1 FROM collection_jobs j WHERE j.purpose = 'renewal' AND j.account_id = s.id)")
G.add("j5_head_of_line", "outbox", lambda o: R.head_of_line(o, "aggregate_id", "id", F.col("status") == "pending").select("id", "aggregate_id"),
      "SELECT id, aggregate_id FROM outbox c WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM outbox e WHERE e.status = 'pending' AND e.aggregate_id = c.aggregate_id AND e.id < c.id)")
G.add("j6_exact_pair", "conversation_members", lambda m: R.exact_pair(m, "user", "assistant"),
      "SELECT conversation_id FROM conversation_members WHERE status = 'active' GROUP BY 1 HAVING count(*) = 2 AND count(*) FILTER (user_id IN ('user', 'assistant')) = 2")
G.add("j7_lateral_scalar", "calls clock", lambda c, k: c.crossJoin(F.broadcast(k.limit(1))).select("id", (F.col("created_s") < F.col("now_s")).alias("before_now")),
      "SELECT c.id, t.before_now FROM calls c, LATERAL (SELECT c.created_s < now_s AS before_now FROM clock) t")
G.add("j8_correlated_count", "organizations organization_members", lambda o, m: o.join(m.where("status in ('active', 'invited')").groupBy(F.col("organization_id").alias("id")).agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("reserved")),
      "SELECT id, (SELECT count(*) FROM organization_members m WHERE m.organization_id = o.id AND status IN ('active', 'invited')) AS reserved FROM organizations o")
G.add("j9_relational_division", "call_participants", R.all_consented,
      "SELECT call_id, count(*) AS n FROM call_participants WHERE status IN ('joined', 'left') GROUP BY call_id HAVING count(*) >= 2 AND bool_and(consented)")
G.add("j11_null_safe_equal", "rooms", lambda r: r.alias("a").join(r.alias("b"), F.col("a.last_message_s").eqNullSafe(F.col("b.last_message_s")) & (F.col("a.organization_id") == F.col("b.organization_id")) & (F.col("a.type") == F.col("b.type"))).groupBy(F.col("a.id").alias("id")).agg(F.count("*").alias("peers")),
      "SELECT a.id, count(*) AS peers FROM rooms a JOIN rooms b ON a.last_message_s IS NOT DISTINCT FROM b.last_message_s AND a.organization_id = b.organization_id AND a.type = b.type GROUP BY a.id")
G.add("j12_batch_enrich", "rooms attachments", lambda r, a: R.batch_enrich(r.select("id"), a.select("conversation_id", F.col("id").alias("file")), "conversation_id", ["file"], "files").select("id", F.array_join(F.transform("files", lambda x: x["file"].cast("string")), ",").alias("files")),
      "SELECT r.id, coalesce(string_agg(CAST(a.id AS VARCHAR), ',' ORDER BY a.id), '') AS files FROM rooms r LEFT JOIN attachments a ON a.conversation_id = r.id GROUP BY r.id")
G.add("j13_any_array_lookup", "messages", lambda m: m.where(F.array_contains(F.sequence(F.lit(0), F.lit(400000), F.lit(3001)), F.col("id"))).select("id"),
      "SELECT id FROM messages WHERE id = ANY(range(0, 400001, 3001))")

# Aggregates

UNREAD = """SELECT m.conversation_id, m.user_id, count(*) FILTER (WHERE s.id > coalesce(r.last_read_message_id, 0) AND s.sender_user_id <> m.user_id) AS unread, coalesce(max(s.id), 0) AS latest_id
FROM conversation_members m LEFT JOIN read_state r ON r.conversation_id = m.conversation_id AND r.user_id = m.user_id
LEFT JOIN messages s ON s.conversation_id = m.conversation_id AND NOT s.deleted WHERE m.status = 'active' GROUP BY 1, 2"""
G.add("a1_unread_counts", "messages conversation_members read_state", R.unread_counts, UNREAD)
G.add("a2_total_unread", "messages conversation_members read_state", lambda *t: R.unread_counts(*t).groupBy("user_id").agg(F.sum("unread").alias("total")), f"SELECT user_id, CAST(sum(unread) AS BIGINT) AS total FROM ({UNREAD}) GROUP BY 1")
G.add("a3_members_json", "organization_members", R.members_json,
      """SELECT organization_id, CAST(count(*) AS INTEGER) AS members, string_agg(CAST(user_id AS VARCHAR) || ':' || role, ',' ORDER BY CASE role WHEN 'owner' THEN 0 WHEN 'admin' THEN 1 ELSE 2 END, created_s, id) AS ordered
      FROM organization_members WHERE status <> 'removed' GROUP BY 1""")
G.add("a4_filtered_aggregate", "calls", lambda c: c.groupBy("organization_id").agg(F.count_if(F.col("status") == "missed").alias("missed"), F.min(F.when(F.col("status") == "active", F.col("id"))).alias("first_active")),
      "SELECT organization_id, count(*) FILTER (status = 'missed') AS missed, min(id) FILTER (status = 'active') AS first_active FROM calls GROUP BY 1")
G.add("a5_having_violations", "calls", lambda c: c.where("status in ('ringing', 'active')").groupBy("conversation_id").count().where("count > 1").select("conversation_id", F.col("count").alias("live")),
      "SELECT conversation_id, count(*) AS live FROM calls WHERE status IN ('ringing', 'active') GROUP BY 1 HAVING count(*) > 1")
G.add("a6_seat_counts", "organization_members", R.seat_counts,
      """SELECT organization_id, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'invited') AS invited, count(*) FILTER (status IN ('active', 'invited')) AS reserved,
      count(*) FILTER (role = 'owner' AND status = 'active') AS owners FROM organization_members GROUP BY 1""")
G.add("a7_quota_usage", "organizations attachments", lambda o, a: o.join(a.groupBy(F.col("organization_id").alias("id")).agg(F.sum("file_size_bytes").alias("used")), "id", "left").select("id", F.coalesce("used", F.lit(0)).cast("long").alias("used"), (F.coalesce("used", F.lit(0)) + 50_000 <= 400_000).alias("fits")),
      "SELECT o.id, CAST(coalesce(sum(a.file_size_bytes), 0) AS BIGINT) AS used, coalesce(sum(a.file_size_bytes), 0) + 50000 <= 400000 AS fits FROM organizations o LEFT JOIN attachments a ON a.organization_id = o.id GROUP BY o.id")
G.add("a8_latest_id", "conversation_members messages", lambda m, s: m.where("status = 'active'").join(s.where("not deleted"), "conversation_id", "left").groupBy("user_id").agg(F.coalesce(F.max("id"), F.lit(0)).alias("latest")),
      "SELECT m.user_id, coalesce(max(s.id), 0) AS latest FROM conversation_members m LEFT JOIN messages s ON s.conversation_id = m.conversation_id AND NOT s.deleted WHERE m.status = 'active' GROUP BY 1")
G.add("a9_distinct_recipients", "conversation_members", lambda m: m.where("status <> 'removed'").select("organization_id", "user_id").distinct(),
      "SELECT DISTINCT organization_id, user_id FROM conversation_members WHERE status <> 'removed'")
G.add("a10_duplicate_content", "attachments", R.duplicate_content,
      "SELECT id, first_id FROM (SELECT id, min(id) OVER (PARTITION BY file_size_bytes, checksum) AS first_id FROM attachments) WHERE id <> first_id")


def _documents(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.length("text").alias("file_size_bytes"), F.sha2("text", 256).alias("checksum"))


G.add("a10_duplicate_documents", "documents", lambda d: R.duplicate_content(_documents(d), "doc_id"),
      "SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents) WHERE doc_id <> first_id")
G.add("a11_batch_summary", "collection_jobs", lambda j: j.groupBy("account_id").agg(F.count_if(F.col("status") == "done").alias("succeeded"), F.count_if(F.col("status") == "review").alias("failed"), F.count_distinct("amount").alias("distinct_amounts"), F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("items")),
      "SELECT account_id, count(*) FILTER (status = 'done') AS succeeded, count(*) FILTER (status = 'review') AS failed, count(DISTINCT amount) AS distinct_amounts, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS items FROM collection_jobs GROUP BY 1")
G.add("a12_review_backlog", "collection_jobs", lambda j: j.agg(F.count_if(F.col("status") == "review").alias("backlog")), "SELECT count(*) FILTER (status = 'review') AS backlog FROM collection_jobs")
G.add("a13_min_order_pending", "lineitem", lambda l: l.where("l_linestatus = 'O'").withColumn("least", F.min("l_linenumber").over(Window.partitionBy("l_orderkey"))).where("l_linenumber = least").select("l_orderkey", "l_linenumber"),
      "SELECT l_orderkey, l_linenumber FROM (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS least FROM lineitem WHERE l_linestatus = 'O') WHERE l_linenumber = least")
G.add("a14_envelope_status", "lineitem", lambda l: l.groupBy("l_orderkey").agg(F.when(F.bool_and(F.col("l_linestatus") == "F"), "completed").otherwise("partially_signed").alias("status")),
      "SELECT l_orderkey, CASE WHEN bool_and(l_linestatus = 'F') THEN 'completed' ELSE 'partially_signed' END AS status FROM lineitem GROUP BY 1")

# Windows

G.add("n1_audit_chain_verify", "audit_events", lambda e: R.verify_chain(e, F.expr(SHA)),
      """SELECT organization_id, count(*) AS total, count(*) FILTER (bad) AS invalid, min(id) FILTER (bad) AS first_invalid FROM (
      SELECT *, NOT (previous_hash IS NOT DISTINCT FROM lag(event_hash) OVER (PARTITION BY organization_id ORDER BY id) AND event_hash = sha256(canonical)) AS bad FROM audit_events) GROUP BY 1""")
G.add("n2_audit_chain_build", "audit_events", lambda e: R.build_chain(e).select("organization_id", "id", "previous_hash", "event_hash"),
      """SELECT organization_id, id, previous_hash, event_hash FROM (WITH RECURSIVE n AS MATERIALIZED (SELECT organization_id, id, canonical, row_number() OVER (PARTITION BY organization_id ORDER BY id) AS k FROM audit_events),
      c AS (SELECT organization_id, id, k, NULL::VARCHAR AS previous_hash, sha256('|' || canonical) AS event_hash FROM n WHERE k = 1 UNION ALL
      SELECT n.organization_id, n.id, n.k, c.event_hash, sha256(c.event_hash || '|' || n.canonical) FROM c JOIN n ON n.organization_id = c.organization_id AND n.k = c.k + 1) SELECT * FROM c)""")
G.add("n2_built_chain_verifies", "audit_events", lambda e: R.verify_chain(R.build_chain(e), R.chained_hash()), "SELECT organization_id, count(*) AS total, 0 AS invalid, NULL::BIGINT AS first_invalid FROM audit_events GROUP BY 1")
G.add("n3_first_per_key", "messages", lambda m: R.first_per_key(m, ["conversation_id", "sender_user_id", "client_message_id"], "id", m.where("id % 1000 >= 900").select("conversation_id", "sender_user_id", "client_message_id")).select("id", "client_message_id"),
      "SELECT min(id) AS id, client_message_id FROM messages m WHERE NOT EXISTS (SELECT 1 FROM messages t WHERE t.id % 1000 >= 900 AND t.conversation_id = m.conversation_id AND t.sender_user_id = m.sender_user_id AND t.client_message_id = m.client_message_id) GROUP BY conversation_id, sender_user_id, client_message_id")
G.add("n4_running_islands", "messages", lambda m: R.islands(m, ["conversation_id"], ["id"], "message_type").groupBy("conversation_id", "island").agg(F.min("id").alias("first"), F.count("*").alias("n")).select("conversation_id", "first", "n"),
      """SELECT conversation_id, min(id) AS first, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY conversation_id ORDER BY id) AS island FROM (
      SELECT *, CASE WHEN message_type IS NOT DISTINCT FROM lag(message_type) OVER (PARTITION BY conversation_id ORDER BY id) THEN 0 ELSE 1 END AS c FROM messages)) GROUP BY conversation_id, island""")
G.add("n5_window_usage_count", "outbox", lambda o: R.usage_in_window(o, "aggregate_id", "available_s", 86_400).select("id", "in_window"),
      "SELECT id, count(*) OVER (PARTITION BY aggregate_id ORDER BY available_s RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS in_window FROM outbox")
SPANS = "SELECT l_orderkey AS doc_id, CAST(l_quantity AS INTEGER) AS start, CAST(l_quantity AS INTEGER) + l_linenumber * 2 AS \"end\" FROM lineitem"


def line_spans(l: DataFrame) -> DataFrame:
    start = F.col("l_quantity").cast("int")
    return l.select(F.col("l_orderkey").alias("doc_id"), start.alias("start"), (start + F.col("l_linenumber") * 2).alias("end"))


G.add("n6_sweep_merge", "lineitem", lambda l: R.sweep_merge(line_spans(l), "doc_id"),
      f"""SELECT doc_id, min(start) AS start, max("end") AS "end", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start, "end" DESC ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT *, CASE WHEN start < max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ({SPANS}))) GROUP BY doc_id, g""")

# Paging

G.add("p1_keyset_page", "messages", lambda m: R.keyset_page(m.where("not deleted"), 50, before=60_000).select("id", "conversation_id"), "SELECT id, conversation_id FROM messages WHERE NOT deleted AND id < 60000 ORDER BY id DESC LIMIT 50")
G.add("p2_keyset_page_composite", "attachments", lambda a: R.keyset_page_composite(a, 1_704_067_200 + 7200 * 200, 200, 30).select("id", "created_s"),
      f"SELECT id, created_s FROM attachments WHERE (created_s, id) < ({1_704_067_200 + 7200 * 200}, 200) ORDER BY created_s DESC, id DESC LIMIT 31")
G.add("p3_metadata_filter", "attachments", lambda a: a.where(F.lower("filename").contains("page=2") & (F.col("id") % 2 == 0)).select("id", "filename"), "SELECT id, filename FROM attachments WHERE contains(lower(filename), 'page=2') AND id % 2 = 0")
G.add("p4_replay_after", "messages conversation_members", lambda m, c: R.keyset_page(m.join(c.where("status = 'active'").select("conversation_id", F.col("user_id").alias("sender_user_id"), "status"), ["conversation_id", "sender_user_id"]), 40, after=5_000).select("id", "sender_user_id", "status"),
      "SELECT m.id, m.sender_user_id, c.status FROM messages m JOIN conversation_members c ON c.conversation_id = m.conversation_id AND c.user_id = m.sender_user_id AND c.status = 'active' WHERE m.id > 5000 ORDER BY m.id LIMIT 40")


def notifications(m: DataFrame, c: DataFrame, user: str = "observer", after: int = 1_000, size: int = 25) -> DataFrame:
    mine = c.where((F.col("user_id") == user) & (F.col("status") == "active")).select("conversation_id")
    rows = m.join(mine, "conversation_id", "left_semi").where((F.col("sender_user_id") != user) & (F.col("message_type") == "text") & ~F.col("deleted") & (F.col("id") > after))
    mark = rows.agg(F.max("id").alias("high_water"))
    return rows.orderBy(F.desc("id")).limit(size).crossJoin(F.broadcast(mark)).select("id", "high_water").orderBy("id")


G.add("p5_notifications_since", "messages conversation_members", notifications,
      """SELECT id, (SELECT max(m.id) FROM messages m JOIN conversation_members c ON c.conversation_id = m.conversation_id AND c.user_id = 'observer' AND c.status = 'active' WHERE m.message_type = 'text' AND NOT deleted AND m.id > 1000) AS high_water
      FROM (SELECT m.id FROM messages m JOIN conversation_members c ON c.conversation_id = m.conversation_id AND c.user_id = 'observer' AND c.status = 'active' WHERE m.sender_user_id <> 'observer' AND m.message_type = 'text' AND NOT deleted AND m.id > 1000 ORDER BY m.id DESC LIMIT 25)""")
G.add("p6_nulls_first_batch", "subscriptions", lambda s: s.orderBy(F.col("last_reconciled_s").asc_nulls_first(), "id").limit(100).select("id", "last_reconciled_s"), "SELECT id, last_reconciled_s FROM subscriptions ORDER BY last_reconciled_s ASC NULLS FIRST, id LIMIT 100")
PLAN_SQL = "CASE plan WHEN 'enterprise' THEN 3 WHEN 'business' THEN 2 ELSE 1 END"


def best() -> Window:
    return Window.partitionBy("user_id").orderBy(plan_rank().desc(), F.desc("seats"), F.desc("period_start_s"), F.desc("id"))


G.add("p7_best_per_user", "subscriptions", lambda s: s.where("status = 'active'").withColumn("n", F.row_number().over(best())).where("n = 1").select("user_id", "id", "plan"),
      f"SELECT user_id, id, plan FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {PLAN_SQL} DESC, seats DESC, period_start_s DESC, id DESC) AS n FROM subscriptions WHERE status = 'active') WHERE n = 1")
G.add("p8_conversation_recency", "rooms", lambda r: r.select("id", F.coalesce("last_message_s", "updated_s").alias("recent_s"), F.row_number().over(Window.partitionBy("organization_id").orderBy(F.coalesce("last_message_s", "updated_s").desc(), "id")).alias("place")),
      "SELECT id, coalesce(last_message_s, updated_s) AS recent_s, CAST(row_number() OVER (PARTITION BY organization_id ORDER BY coalesce(last_message_s, updated_s) DESC, id) AS INTEGER) AS place FROM rooms")
WORDS_SQL = r"' ' || trim(regexp_replace(lower(body), '[^\p{L}\p{N}_]+', ' ', 'g')) || ' '"
G.add("p9_message_search", "messages conversation_members", lambda m, c: S.message_search(m, c, "observer", 'the and -"of the" OR "in the"').select("id", "conversation_id"),
      f"""SELECT id, m.conversation_id FROM messages m WHERE NOT deleted AND message_type = 'text' AND EXISTS (SELECT 1 FROM conversation_members c WHERE c.conversation_id = m.conversation_id AND c.user_id = 'observer' AND c.status = 'active')
      AND ((contains({WORDS_SQL}, ' the ') AND contains({WORDS_SQL}, ' and ') AND NOT contains({WORDS_SQL}, ' of the ')) OR contains({WORDS_SQL}, ' in the '))""")

COUNT_SQL = r"len(list_filter(string_split_regex(lower(body), '[^\p{L}\p{N}_]+'), lambda w: w = 'the'))"
MINE_SQL = "SELECT * FROM messages m WHERE NOT deleted AND message_type = 'text' AND EXISTS (SELECT 1 FROM conversation_members c WHERE c.conversation_id = m.conversation_id AND c.user_id = 'observer' AND c.status = 'active')"
G.add("p9_search_rank", "messages conversation_members", lambda m, c: S.message_search(m, c, "observer", "the").select("id", F.round("rank", 6).alias("rank")),
      f"SELECT id, round(0.1 * {COUNT_SQL}, 6) AS rank FROM ({MINE_SQL}) WHERE {COUNT_SQL} > 0")
G.add("p9_search_page", "messages conversation_members", lambda m, c: S.ranked_page(S.message_search(m, c, "observer", "the").withColumn("rank", F.round("rank", 6)), 50, (0.4, 60_000)).select("id", "rank"),
      f"SELECT id, rank FROM (SELECT id, round(0.1 * {COUNT_SQL}, 6) AS rank FROM ({MINE_SQL}) WHERE {COUNT_SQL} > 0) WHERE rank < 0.4 OR (rank = 0.4 AND id < 60000) ORDER BY rank DESC, id DESC LIMIT 50")
G.add("p9_search_covers", "messages conversation_members", lambda m, c: S.message_search(m, c, "observer", '"of the" and OR in the').select("id", F.round("rank", 6).alias("rank")))


def schedule(links: DataFrame, clock: DataFrame) -> DataFrame:
    both = links.crossJoin(F.broadcast(clock.limit(1)))
    return R.schedule_order(both, F.col("now_s")).limit(200).select("id", "upcoming")


G.add("p10_schedule_order", "call_links clock", schedule,
      """SELECT id, upcoming FROM (SELECT *, start_s + duration_minutes * 60 > now_s AS upcoming FROM call_links, clock)
      ORDER BY upcoming DESC, CASE WHEN upcoming THEN start_s END ASC NULLS LAST, CASE WHEN NOT upcoming THEN start_s END DESC NULLS LAST, id DESC LIMIT 200""")

# Sets

G.add("u1_union_all", "subscriptions organizations", lambda s, o: s.where("reconciliation_error is not null").select(F.lit("user").alias("kind"), F.col("id")).unionByName(o.select(F.lit("organization").alias("kind"), F.col("id").cast("long").alias("id"))),
      "SELECT 'user' AS kind, id FROM subscriptions WHERE reconciliation_error IS NOT NULL UNION ALL SELECT 'organization', CAST(id AS BIGINT) FROM organizations")
G.add("u2_union_distinct", "subscriptions organization_members", lambda s, m: s.select("user_id").union(m.select("user_id")).distinct(), "SELECT user_id FROM subscriptions UNION SELECT user_id FROM organization_members")
G.add("u3_multiset_difference", "messages conversation_members", lambda m, c: m.select("conversation_id", F.col("sender_user_id").alias("user_id")).exceptAll(c.select("conversation_id", "user_id")).groupBy("conversation_id", "user_id").agg(F.count("*").alias("n")),
      "SELECT conversation_id, user_id, count(*) AS n FROM (SELECT conversation_id, sender_user_id AS user_id FROM messages EXCEPT ALL SELECT conversation_id, user_id FROM conversation_members) GROUP BY 1, 2")
G.add("u4_subset_test", "call_participants", lambda p: p.groupBy("call_id").agg(F.collect_set(F.when(F.col("status") == "joined", F.col("user_id"))).alias("j"), F.collect_set(F.when(F.col("consented"), F.col("user_id"))).alias("c")).select("call_id", (F.size(F.array_except("j", "c")) == 0).alias("covered")),
      "SELECT call_id, count(*) FILTER (status = 'joined' AND NOT consented) = 0 AS covered FROM call_participants GROUP BY 1")
