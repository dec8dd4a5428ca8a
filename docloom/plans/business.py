"""Queries over accounts, billing, calls and retention, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import billing as B
from docloom.operators import business as O
from docloom.operators import relational as R
from docloom.plans.registry import Group

G = Group()
DAY = 86_400
NOW = 1_704_067_200 + 20 * DAY


def clocked(rows: DataFrame, clock: DataFrame) -> DataFrame:
    return rows.crossJoin(F.broadcast(clock.limit(1)))


# Scalars

G.add("e1_next_month_anchor", "orders", lambda o: o.select("o_orderkey", F.unix_seconds(B.next_month(F.col("o_orderdate").cast("timestamp"), F.when(F.col("o_orderkey") % 2 == 0, "paystack").otherwise("stripe"), F.when(F.col("o_orderkey") % 3 == 0, 31))).alias("next_s")),
      """SELECT o_orderkey, CAST(epoch(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH) AS BIGINT) + 86400 * (least(CASE WHEN o_orderkey % 3 = 0 THEN 31 ELSE day(o_orderdate) END,
      CASE WHEN o_orderkey % 2 = 0 THEN 28 ELSE day(last_day(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)) END) - 1) + CAST(epoch(o_orderdate) - epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS next_s FROM orders""")
G.add("e2_renewal_period", "subscriptions", lambda s: s.select("id", "period_end_s", B.grace_end(F.col("period_end_s")).alias("grace_s")), f"SELECT id, period_end_s, period_end_s + 7 * {DAY} AS grace_s FROM subscriptions")


def prorated(s: DataFrame) -> DataFrame:
    us = lambda c: F.col(c) * 1_000_000
    now = us("period_start_s") + F.col("id") % 41 * DAY * 1_000_000 + 1
    return s.select("id", B.prorated_amount(F.col("amount"), F.col("seats"), us("period_start_s"), us("period_end_s"), now).alias("price"))


G.add("e3_prorated_amount", "subscriptions", prorated,
      f"""SELECT id, CASE WHEN id % 41 < 30 THEN CAST((CAST(amount * seats AS HUGEINT) * (30 * {DAY} * 1000000::HUGEINT - (id % 41) * {DAY} * 1000000 - 1) + 30 * {DAY} * 1000000::HUGEINT - 1) // (30 * {DAY} * 1000000::HUGEINT) AS BIGINT) END AS price FROM subscriptions""")
G.add("e4_retry_at", "collection_jobs clock", lambda j, c: clocked(j, c).select("id", B.retry_at(F.col("next_attempt_s"), F.col("attempts"), F.col("now_s"), F.col("deadline_s")).alias("retry_s")),
      f"""SELECT id, CASE WHEN attempts BETWEEN 1 AND 4 AND t < deadline_s THEN t END AS retry_s FROM (SELECT *, greatest(next_attempt_s + {DAY} * CASE attempts WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 6 END, now_s + {DAY}) AS t FROM collection_jobs, clock)""")
G.add("e5_seat_count_valid", "subscriptions", lambda s: s.select("id", B.seats_valid(F.col("plan"), F.col("seats") * 3 - 2).alias("valid")),
      "SELECT id, seats * 3 - 2 >= 1 AND CASE plan WHEN 'personal' THEN seats * 3 - 2 = 1 WHEN 'business' THEN seats * 3 - 2 <= 19 ELSE true END AS valid FROM subscriptions")
def access():
    return B.subscription_access(F.col("status"), F.col("period_end_s"), F.col("provider"), F.when(F.col("id") % 6 != 0, F.col("id").cast("string")), F.col("cancel_at_period_end"), F.col("id") % 29 == 0, F.col("now_s"))
G.add("e6_subscription_access", "subscriptions clock", lambda s, c: clocked(s, c).select("id", access().alias("a")).select("id", "a.has_access", "a.cutoff_s", "a.grace_s"),
      f"""SELECT id, CASE WHEN id % 29 = 0 THEN false ELSE now_s < coalesce(g, period_end_s) END AS has_access, CASE WHEN id % 29 <> 0 THEN coalesce(g, period_end_s) END AS cutoff_s, CASE WHEN id % 29 <> 0 THEN g END AS grace_s FROM (
      SELECT *, CASE WHEN id % 6 <> 0 AND status <> 'cancelled' AND NOT cancel_at_period_end THEN period_end_s + 7 * {DAY} END AS g FROM subscriptions, clock)""")
G.add("e7_restore_deadline", "subscriptions clock", lambda s, c: clocked(s, c).select("id", B.restore_deadline(F.col("period_end_s"), F.col("now_s")).alias("until_s")), f"SELECT id, CASE WHEN period_end_s > now_s THEN period_end_s ELSE now_s END + 30 * {DAY} AS until_s FROM subscriptions, clock")
G.add("e8_tombstone_id", "customer", lambda c: c.select("c_custkey", B.tombstone(F.col("c_custkey")).alias("name")), "SELECT c_custkey, 'deleted:' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 32) AS name FROM customer")


FEATURES = sorted(O.FREE_CREDITS.keys() | O.PAID_CREDITS.keys() | {"pin"})


def requests(events: DataFrame) -> DataFrame:
    """Events as requests for features, half of them on a plan, some in batches, light or auxiliary."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    i, user = F.col("event_id"), F.col("user_id")
    plan = F.when(user % 2 == 0, pick(list(O.BATCH_FACTORS), user))
    return events.select("event_id", "user_id", pick(FEATURES, i * 7).alias("feature"), plan.alias("plan"), (i % 10 == 0).alias("batch"), (i % 6 == 1).alias("light"), (i % 11 == 2).alias("auxiliary"))


def _listed(values) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


def _told(costs: dict[str, int], of: str, other: int) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in costs.items()) + f" ELSE {other} END"


REQUESTS_SQL = f"""SELECT user_id, {_listed(FEATURES)}[CAST(event_id * 7 % {len(FEATURES)} + 1 AS INTEGER)] AS feature, CASE WHEN user_id % 2 = 0 THEN {_listed(O.BATCH_FACTORS)}[CAST(user_id % 3 + 1 AS INTEGER)] END AS plan,
      event_id % 10 = 0 AS batch, event_id % 6 = 1 AS light, event_id % 11 = 2 AS auxiliary FROM events"""
G.add("e9_usage_cost", "events", lambda e: O.usage_cost(requests(e)).groupBy("user_id").agg(F.sum("counted").alias("counted"), F.sum("credits").alias("credits")),
      f"""SELECT user_id, CAST(sum(CASE WHEN auxiliary THEN 0 WHEN plan IS NULL AND light THEN 1 ELSE c END) AS BIGINT) AS counted, CAST(sum(c) AS BIGINT) AS credits FROM (SELECT *, CASE WHEN auxiliary THEN 0
      WHEN plan IS NOT NULL THEN {_told(O.PAID_CREDITS, "feature", 0)} * CASE WHEN batch THEN {_told(O.BATCH_FACTORS, "plan", 1)} ELSE 1 END WHEN light THEN 0 ELSE {_told(O.FREE_CREDITS, "feature", 1)} END AS c FROM ({REQUESTS_SQL})) GROUP BY 1""")
G.add("e10_backoff_seconds", "outbox", lambda o: o.select("id", B.backoff_seconds(F.col("attempts") * 2).alias("delay_s"), B.push_backoff_seconds(F.col("attempts")).alias("push_s")),
      "SELECT id, CAST(least(pow(2, least(greatest(attempts * 2 - 1, 0), 8)), 300) AS BIGINT) AS delay_s, CAST(least(3600, 30 * pow(2, least(attempts, 7))) AS BIGINT) AS push_s FROM outbox")
G.add("e11_word_count", "documents", lambda d: d.select("doc_id", F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("words")), r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS INTEGER) AS words FROM documents")
G.add("e12_array_order_dedupe", "conversations", lambda c: c.select("conv_id", "turn", F.array_join(F.array_distinct(F.split(F.lower("text"), " ")), " ").alias("words")),
      "SELECT conv_id, turn, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: list_position(w, p[1]) = p[2]), lambda p: p[1]), ' ') AS words FROM (SELECT *, string_split(lower(text), ' ') AS w FROM conversations)")
G.add("e13_preview_text", "messages policies", lambda m, p: m.join(p, "organization_id", "left").select("id", B.preview_text(F.col("body"), F.col("previews_enabled")).alias("preview")), "SELECT id, CASE WHEN previews_enabled THEN left(body, 180) END AS preview FROM messages m LEFT JOIN policies p USING (organization_id)")
G.add("e14_canonical_string", "calls", lambda c: c.select("id", F.sha2(B.canonical(F.col("id"), F.col("created_by"), F.col("scheduled_end_s"), F.col("provider_finished_s")), 256).alias("hash")),
      "SELECT id, sha256(concat_ws('|', CAST(id AS VARCHAR), created_by, coalesce(CAST(scheduled_end_s AS VARCHAR), ''), coalesce(CAST(provider_finished_s AS VARCHAR), ''))) AS hash FROM calls")
G.add("e15_join_window_status", "call_links clock", lambda l, c: clocked(l, c).select("id", B.join_window(F.col("status"), F.col("start_s"), F.col("duration_minutes"), F.col("now_s")).alias("state")),
      "SELECT id, CASE WHEN status IN ('cancelled', 'completed') THEN status WHEN now_s < start_s - 900 THEN 'too_early' WHEN now_s >= start_s + duration_minutes * 60 THEN 'expired' ELSE 'open' END AS state FROM call_links, clock")

# Pipelines


def user_plans(users: DataFrame, subs: DataFrame, members: DataFrame, orgs: DataFrame) -> DataFrame:
    plans = orgs.where("id % 3 = 0").select(F.col("id").alias("organization_id"), F.when(F.col("id") % 2 == 0, "enterprise").otherwise("business").alias("plan"), F.col("max_accounts").alias("seats"), F.col("id"))
    return O.entitlement(users.select(F.col("c_custkey").alias("user_id")), subs, members, plans)


G.add("b1_entitlement", "customer subscriptions organization_members organizations", user_plans,
      """SELECT c_custkey AS user_id, coalesce(g.plan, s.plan, 'free') AS plan FROM customer
      LEFT JOIN (SELECT user_id, CASE WHEN organization_id % 2 = 0 THEN 'enterprise' ELSE 'business' END AS plan FROM organization_members WHERE status = 'active' AND organization_id % 3 = 0) g ON g.user_id = c_custkey
      LEFT JOIN (SELECT user_id, plan FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE plan WHEN 'enterprise' THEN 3 WHEN 'business' THEN 2 ELSE 1 END DESC, seats DESC, id DESC) AS n FROM subscriptions WHERE status IN ('active', 'past_due')) WHERE n = 1) s ON s.user_id = c_custkey""")
G.add("b2_expire_access", "subscriptions clock", lambda s, c: clocked(s, c).where("status in ('active', 'past_due') and period_end_s <= now_s").select("id", F.lit("inactive").alias("new_status")), "SELECT id, 'inactive' AS new_status FROM subscriptions, clock WHERE status IN ('active', 'past_due') AND period_end_s <= now_s")
G.add("b3_reconciliation_queue", "subscriptions clock organizations", lambda s, c, o: clocked(s, c).where(f"reconciliation_error is null or last_reconciled_s < now_s - 30 * {DAY}").select(F.lit("user").alias("kind"), "id", "last_reconciled_s").unionByName(o.select(F.lit("organization").alias("kind"), F.col("id").cast("long").alias("id"), F.col("updated_s").cast("long").alias("last_reconciled_s"))).orderBy(F.col("last_reconciled_s").asc_nulls_first(), "kind", "id").limit(200),
      f"SELECT * FROM (SELECT 'user' AS kind, id, last_reconciled_s FROM subscriptions, clock WHERE reconciliation_error IS NULL OR last_reconciled_s < now_s - 30 * {DAY} UNION ALL SELECT 'organization', CAST(id AS BIGINT), CAST(updated_s AS BIGINT) FROM organizations) ORDER BY last_reconciled_s ASC NULLS FIRST, kind, id LIMIT 200")
G.add("b4_renewals_due", "subscriptions clock collection_jobs", lambda s, c, j: clocked(s, c).where("status = 'active' and not cancel_at_period_end and period_end_s <= now_s").join(j.where("purpose = 'renewal'").select(F.col("account_id").alias("id")), "id", "left_anti").select("id"),
      "SELECT id FROM subscriptions s, clock WHERE status = 'active' AND NOT cancel_at_period_end AND period_end_s <= now_s AND NOT EXISTS (SELECT 1 FROM collection_jobs j WHERE j.purpose = 'renewal' AND j.account_id = s.id)")
G.add("b5_collection_jobs_due", "collection_jobs clock", lambda j, c: clocked(j, c).alias("j").join(j.where("attempts >= 5").select("account_id").distinct().withColumn("recent", F.lit(True)), "account_id", "left").where("(status = 'open' and next_attempt_s <= now_s) or (status = 'review' and recent)").select("id", "status"),
      "SELECT id, status FROM collection_jobs j, clock WHERE (status = 'open' AND next_attempt_s <= now_s) OR (status = 'review' AND EXISTS (SELECT 1 FROM collection_jobs r WHERE r.account_id = j.account_id AND r.attempts >= 5))")
UNPAID = "organization_id % 7 = 3"
G.add("b6_stale_calls", "calls call_participants", lambda c, p: O.stale_calls(c, p, c.where(UNPAID).select("organization_id").distinct(), F.lit(NOW), 20 * DAY, 3600).select("id", "reason"),
      f"""SELECT * FROM (SELECT id, CASE WHEN status = 'ringing' AND ringing_expires_s <= {NOW} THEN 'ringing_expired' WHEN status = 'active' AND scheduled_end_s <= {NOW} THEN 'schedule_over' WHEN status = 'active' AND created_s <= {NOW} - 20 * {DAY} THEN 'too_long'
      WHEN status = 'active' AND NOT EXISTS (SELECT 1 FROM call_participants p WHERE p.call_id = c.id AND p.status = 'joined') AND EXISTS (SELECT 1 FROM call_participants p WHERE p.call_id = c.id AND p.status = 'left') AND coalesce(provider_finished_s, created_s) <= {NOW} - 3600 THEN 'abandoned'
      WHEN status IN ('ringing', 'active') AND {UNPAID} THEN 'unpaid' END AS reason FROM calls c) WHERE reason IS NOT NULL""")
G.add("b7_presence", "organization_members call_participants outbox", lambda m, p, o: O.presence(m.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id")), p.select(F.concat(F.lit("u"), (F.col("call_id") % 97).cast("string")).alias("user_id"), "status"), o.groupBy(F.concat(F.lit("u"), (F.col("id") % 150).cast("string")).alias("user_id")).agg(F.max("available_s").alias("last_seen_s")), F.lit(NOW + 9 * DAY), 2 * DAY),
      f"""SELECT u AS user_id, CASE WHEN EXISTS (SELECT 1 FROM call_participants p WHERE p.status = 'joined' AND 'u' || CAST(p.call_id % 97 AS VARCHAR) = u) THEN 'in_call' WHEN s >= {NOW} + 7 * {DAY} THEN 'online' ELSE 'offline' END AS presence, s AS last_seen_s
      FROM (SELECT 'u' || CAST(user_id AS VARCHAR) AS u FROM organization_members) LEFT JOIN (SELECT 'u' || CAST(id % 150 AS VARCHAR) AS k, max(available_s) AS s FROM outbox GROUP BY 1) ON k = u""")
FANOUT = """SELECT DISTINCT 'message:' || CAST(m.id AS VARCHAR) || ':' || c.user_id AS event_key, m.id, m.conversation_id, c.user_id AS recipient, CASE WHEN previews_enabled THEN left(body, 180) END AS preview
FROM messages m JOIN policies p ON p.organization_id = m.organization_id AND p.push_enabled JOIN conversation_members c ON c.conversation_id = m.conversation_id AND c.status = 'active' WHERE NOT m.deleted AND m.message_type = 'text' AND c.user_id <> m.sender_user_id"""
G.add("b8_notification_fanout", "messages conversation_members policies", O.notification_fanout, FANOUT)


def suppressed(m: DataFrame, c: DataFrame, p: DataFrame, r: DataFrame) -> DataFrame:
    n = O.notification_fanout(m, c, p)
    marks = r.select("conversation_id", F.col("user_id").alias("recipient"), "last_read_message_id")
    return n.join(marks, ["conversation_id", "recipient"], "left").where("last_read_message_id is null or id > last_read_message_id").select("event_key")


G.add("b9_suppress_read", "messages conversation_members policies read_state", suppressed, f"SELECT event_key FROM ({FANOUT}) n LEFT JOIN read_state r ON r.conversation_id = n.conversation_id AND r.user_id = n.recipient WHERE r.last_read_message_id IS NULL OR n.id > r.last_read_message_id")
G.add("b10_retention_due_attachments", "attachments policies", lambda a, p: a.join(p, "organization_id").where((F.col("created_s") < NOW - 10 * DAY) & ~F.col("legal_hold")).orderBy("created_s", "id").limit(100).select("id"),
      f"SELECT id FROM attachments a JOIN policies p ON p.organization_id = a.organization_id WHERE created_s < {NOW} - 10 * {DAY} AND NOT legal_hold ORDER BY created_s, id LIMIT 100")
G.add("b11_retention_due_recordings", "calls policies", lambda c, p: c.where(F.col("status") == "ended").where(F.col("created_s") + 3 * DAY < NOW).join(p, "organization_id", "left").where(~F.coalesce("legal_hold", F.lit(False))).select("id"),
      f"SELECT id FROM calls c LEFT JOIN policies p USING (organization_id) WHERE status = 'ended' AND created_s + 3 * {DAY} < {NOW} AND NOT coalesce(legal_hold, false)")
G.add("b12_retention_due_uploads", "outbox", lambda o: o.where(((F.col("status") == "delivered") & (F.col("available_s") + 5 * DAY < NOW)) | ((F.col("status") == "pending") & (F.col("attempts") == 0) & (F.col("available_s") + DAY < NOW))).select("id", "status"),
      f"SELECT id, status FROM outbox WHERE (status = 'delivered' AND available_s + 5 * {DAY} < {NOW}) OR (status = 'pending' AND attempts = 0 AND available_s + {DAY} < {NOW})")
G.add("b13_retention_due_artifacts", "outbox", lambda o: o.select("id", F.when(F.col("id") % 6 != 0, F.col("available_s")).alias("made_s"), F.col("locked_s").alias("expires_s")).where(F.coalesce("expires_s", F.col("made_s") + 3600, F.lit(0)) <= NOW).select("id"),
      f"SELECT id FROM outbox WHERE coalesce(locked_s, CASE WHEN id % 6 <> 0 THEN available_s END + 3600, 0) <= {NOW}")
G.add("b14_accounts_due_purge", "subscriptions clock", lambda s, c: clocked(s, c).where(f"status = 'cancelled' and period_end_s + 30 * {DAY} <= now_s and (last_reconciled_s is null or last_reconciled_s < now_s - 600)").orderBy("period_end_s", "id").limit(50).select("id"),
      f"SELECT id FROM subscriptions, clock WHERE status = 'cancelled' AND period_end_s + 30 * {DAY} <= now_s AND (last_reconciled_s IS NULL OR last_reconciled_s < now_s - 600) ORDER BY period_end_s, id LIMIT 50")
G.add("b15_missed_call_replay", "calls call_participants", lambda c, p: R.keyset_page(c.join(p.where("user_id = 'assistant' and status = 'missed'").select(F.col("call_id").alias("id")), "id", "left_semi"), 60, after=2_000).select("id", "conversation_id"),
      "SELECT id, conversation_id FROM calls c WHERE id > 2000 AND EXISTS (SELECT 1 FROM call_participants p WHERE p.call_id = c.id AND p.user_id = 'assistant' AND p.status = 'missed') ORDER BY id LIMIT 60")
G.add("b16_group_membership_sync", "organization_members", lambda m: O.merge_upsert(m.where("id % 2 = 0").select("user_id", F.lit("removed").alias("status"), F.col("created_s").alias("joined_s")), m.where("id % 3 = 0 and status = 'active'").select("user_id", "status", (F.col("created_s") + 5).alias("joined_s")), "user_id", {"status": "overwrite", "joined_s": "keep"}),
      "SELECT user_id, CASE WHEN id % 3 = 0 AND status = 'active' THEN 'active' ELSE 'removed' END AS status, CASE WHEN id % 2 = 0 THEN created_s ELSE created_s + 5 END AS joined_s FROM organization_members WHERE id % 2 = 0 OR (id % 3 = 0 AND status = 'active')")
G.add("b17_quarantine_expired_jobs", "outbox", lambda o: O.recover_jobs(o.where("status = 'pending'"), F.lit(NOW), 5).select("id", "new_status"), f"SELECT id, CASE WHEN attempts >= 5 THEN 'failed' ELSE 'queued' END AS new_status FROM outbox WHERE status = 'pending' AND (locked_s IS NULL OR locked_s < {NOW})")
G.add("b18_call_fanout", "calls conversation_members policies", O.call_fanout,
      """SELECT DISTINCT 'call:' || CAST(c.id AS VARCHAR) || ':' || m.user_id AS event_key, m.user_id AS recipient, CASE WHEN coalesce(previews_enabled, true) THEN created_by END AS caller
      FROM calls c LEFT JOIN policies p ON p.organization_id = c.organization_id JOIN conversation_members m ON m.conversation_id = c.conversation_id AND m.status = 'active' WHERE coalesce(push_enabled, true) AND m.user_id <> c.created_by""")
G.add("b19_collection_allowed", "collection_jobs subscriptions customer", lambda j, s, c: O.collection_allowed(j, s, c.where("c_custkey % 17 = 0").select(F.col("c_custkey").alias("user_id"))),
      """SELECT j.id, coalesce(s.user_id % 17 <> 0 AND ((purpose = 'seat' AND s.status = 'active') OR (purpose = 'renewal' AND s.status IN ('active', 'past_due') AND NOT cancel_at_period_end)), false) AS allowed
      FROM collection_jobs j LEFT JOIN subscriptions s ON s.id = j.account_id""")
G.add("s13_merge_upsert", "customer", lambda c: O.merge_upsert(c.where("c_custkey % 3 <> 0").select("c_custkey", "c_acctbal", F.col("c_mktsegment").alias("segment")), c.where("c_custkey % 2 = 0").select("c_custkey", (F.col("c_acctbal") * 2).alias("c_acctbal"), F.lit("NEW").alias("segment")), "c_custkey", {"c_acctbal": "greatest", "segment": "overwrite"}),
      "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal * 2 WHEN c_custkey % 2 = 0 THEN greatest(c_acctbal, c_acctbal * 2) ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
G.add("s14_expand_ranges", "part", lambda p: O.expand_ranges(p.select("p_partkey", (F.col("p_partkey") % 5).cast("int").alias("first"), (F.col("p_partkey") % 9).cast("int").alias("last"), F.lit(7).alias("most")), "first", "last", "most").select("p_partkey", "valid", "item"),
      """SELECT p_partkey, v AS valid, unnest(CASE WHEN v THEN range(f, l + 1) ELSE [NULL] END) AS item FROM (SELECT p_partkey, p_partkey % 5 AS f, p_partkey % 9 AS l, p_partkey % 5 >= 1 AND p_partkey % 9 >= p_partkey % 5 AND p_partkey % 9 <= 7 AS v FROM part)""")
DECLINES = ["card_expired", "insufficient_funds", "try again later", "do_not_honor", "unknown", "network error", "lost card try again"]
def code():
    return F.element_at(F.array(*map(F.lit, DECLINES)), (F.col("o_orderkey") % len(DECLINES) + 1).cast("int"))
G.add("c8_decline_retryable", "orders", lambda o: o.select("o_orderkey", B.decline_retryable(code(), F.col("o_orderpriority")).alias("retry")), "SELECT o_orderkey, o_orderkey % 7 IN (1, 2, 5) AS retry FROM orders")
