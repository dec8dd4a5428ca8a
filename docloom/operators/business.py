"""Pipelines of accounts, billing, calls and retention, composed of joins and column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import billing as B

DAY = 86_400
# Credits of a feature without a plan, credits of a feature on a paid plan (others cost none there), factors of batches by plan.
FREE_CREDITS = {
    "convert": 1, "generate_questions": 2, "generate_answers": 2, "transcribe": 3, "text_to_speech": 3, "vault": 1, "redact": 2, "data_mask": 2, "compliance": 4,
    "structured_extract": 3, "e_signature": 2, "edit_pdf": 1, "combine_pdf": 1, "compress_pdf": 1, "lock_pdf": 1, "split_pdf": 1,
}
PAID_CREDITS = {
    "summarize": 1, "explain": 1, "translate": 1, "grammar_correct": 1, "generate_questions": 3, "generate_answers": 3, "transcribe": 5, "text_to_speech": 5,
    "redact": 2, "data_mask": 2, "compliance": 5, "structured_extract": 4,
}
BATCH_FACTORS = {"personal": 10, "business": 25, "enterprise": 50}


def usage_cost(requests: DataFrame, free: dict[str, int] = FREE_CREDITS, paid: dict[str, int] = PAID_CREDITS, factors: dict[str, int] = BATCH_FACTORS) -> DataFrame:
    """Requests (.., feature, plan, batch, light, auxiliary) with ``counted`` and ``credits``, what they count against a total and a heavy quota.

    An auxiliary request is free. Without a plan a light one counts once, another as much as its
    feature costs, one if it is not listed. On a plan only listed features cost, and more in a batch.
    The cost tables are broadcast, a row per feature or plan.
    """
    spark = requests.sparkSession
    costs = spark.createDataFrame([(k, free.get(k), paid.get(k)) for k in sorted(free.keys() | paid.keys())], "feature string, _free int, _paid int")
    plans = spark.createDataFrame(sorted(factors.items()), "plan string, _factor int")
    rows = requests.join(F.broadcast(costs), "feature", "left").join(F.broadcast(plans), "plan", "left")
    own = F.coalesce("_free", F.lit(1))
    by_plan = F.coalesce("_paid", F.lit(0)) * F.when(F.col("batch"), F.coalesce("_factor", F.lit(1))).otherwise(1)
    credits = F.when(F.col("auxiliary"), 0).when(F.col("plan").isNotNull(), by_plan).when(F.col("light"), 0).otherwise(own)
    counted = F.when(F.col("auxiliary"), 0).when(F.col("plan").isNull() & F.col("light"), 1).otherwise(credits)
    return rows.select(*requests.columns, counted.alias("counted"), credits.alias("credits"))


def plan_rank() -> Column:
    return F.when(F.col("plan") == "enterprise", 3).when(F.col("plan") == "business", 2).otherwise(1)


@dataclass(frozen=True)
class Reset:
    """A rule of a column: ``to`` where a condition on the old row ``o`` and the new one ``n`` holds, else what was there.

    A row that is new gets its own value, and a row without a new one keeps its.
    """

    when: str
    to: object = None


Rule = str | Reset


def merge_upsert(old: DataFrame, new: DataFrame, key: str, rules: dict[str, Rule]) -> DataFrame:
    """Upsert rows by key: per column ``overwrite``, ``keep``, ``greatest`` or a ``Reset`` where both have a row. A null key is a key."""
    o, n = old.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    both = o.join(n, F.col(f"o.{key}").eqNullSafe(F.col(f"n.{key}")), "full")
    met = F.col("o._old").isNotNull() & F.col("n._new").isNotNull()

    def merged(c: str, rule: Rule) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if isinstance(rule, Reset):
            return F.when(met & F.expr(rule.when), F.lit(rule.to)).when(F.col("o._old").isNotNull(), a).otherwise(b).alias(c)
        return {"overwrite": F.coalesce(b, a), "keep": F.coalesce(a, b), "greatest": F.greatest(a, b)}[rule].alias(c)

    return both.select(F.when(F.col("n._new").isNotNull(), F.col(f"n.{key}")).otherwise(F.col(f"o.{key}")).alias(key), *[merged(c, r) for c, r in rules.items()])


def expand_ranges(plans: DataFrame, first: str, last: str, most: str) -> DataFrame:
    """A row per item of inclusive ranges, flagged where the range leaves 1 .. most."""
    valid = (F.col(first) >= 1) & (F.col(last) >= F.col(first)) & (F.col(last) <= F.col(most))
    items = F.when(valid, F.sequence(F.col(first), F.col(last))).otherwise(F.array(F.lit(None).cast("int")))
    return plans.withColumn("valid", valid).withColumn("item", F.explode(items))


def entitlement(users: DataFrame, personal: DataFrame, members: DataFrame, organization_plans: DataFrame) -> DataFrame:
    """The plan of each user: that of an organisation over a personal one over free."""
    best = Window.partitionBy("user_id").orderBy(plan_rank().desc(), F.desc("seats"), F.desc("id"))
    top = lambda rows: rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("user_id", "plan")
    through = members.where("status = 'active'").select("user_id", "organization_id").join(organization_plans, "organization_id")
    own = top(personal.where("status in ('active', 'past_due')")).withColumnRenamed("plan", "own")
    given = top(through).withColumnRenamed("plan", "given")
    return users.join(given, "user_id", "left").join(own, "user_id", "left").select("user_id", F.coalesce("given", "own", F.lit("free")).alias("plan"))


def stale_calls(calls: DataFrame, participants: DataFrame, unpaid: DataFrame, now: Column, longest_s: int, empty_s: int) -> DataFrame:
    """Calls to end, with the reason: ringing too long, past their schedule, too long, abandoned, or no longer paid."""
    people = participants.groupBy(F.col("call_id").alias("id")).agg(F.count_if(F.col("status") == "joined").alias("joined"), F.count_if(F.col("status") == "left").alias("gone"))
    rows = calls.join(people, "id", "left").join(unpaid.select("organization_id", F.lit(True).alias("unpaid")), "organization_id", "left")
    active = F.col("status") == "active"
    empty = (F.coalesce("joined", F.lit(0)) == 0) & (F.coalesce("gone", F.lit(0)) > 0) & (F.coalesce("provider_finished_s", "created_s") <= now - empty_s)
    reason = (
        F.when((F.col("status") == "ringing") & (F.col("ringing_expires_s") <= now), "ringing_expired")
        .when(active & (F.col("scheduled_end_s") <= now), "schedule_over")
        .when(active & (F.col("created_s") <= now - longest_s), "too_long")
        .when(active & empty, "abandoned")
        .when(F.col("status").isin("ringing", "active") & F.col("unpaid"), "unpaid")
    )
    return rows.withColumn("reason", reason).where("reason is not null")


def presence(members: DataFrame, participants: DataFrame, seen: DataFrame, now: Column, fresh_s: int = 120) -> DataFrame:
    """in_call over online over offline, with when a user was last seen."""
    busy = participants.where("status = 'joined'").select("user_id").distinct().withColumn("busy", F.lit(True))
    rows = members.join(busy, "user_id", "left").join(seen, "user_id", "left")
    state = F.when(F.col("busy"), "in_call").when(F.col("last_seen_s") >= now - fresh_s, "online").otherwise("offline")
    return rows.select("user_id", state.alias("presence"), "last_seen_s")


def notification_fanout(messages: DataFrame, members: DataFrame, policies: DataFrame) -> DataFrame:
    """A notification per message and active member but the sender, where a policy allows it; without a policy there is none."""
    allowed = policies.where("push_enabled").select("organization_id", "previews_enabled")
    to = members.where("status = 'active'").select("conversation_id", F.col("user_id").alias("recipient"))
    rows = messages.where("not deleted and message_type = 'text'").join(allowed, "organization_id").join(to, "conversation_id").where("recipient <> sender_user_id")
    key = F.concat_ws(":", F.lit("message"), F.col("id").cast("string"), "recipient")
    return rows.select(key.alias("event_key"), "id", "conversation_id", "recipient", B.preview_text(F.col("body"), F.col("previews_enabled")).alias("preview")).dropDuplicates(["event_key"])


def call_fanout(calls: DataFrame, members: DataFrame, policies: DataFrame) -> DataFrame:
    """A notification per call and member but the caller; a missing policy allows it, and without previews the caller isn't named."""
    rows = calls.join(policies, "organization_id", "left").where(F.coalesce("push_enabled", F.lit(True)))
    to = members.where("status = 'active'").select("conversation_id", F.col("user_id").alias("recipient")).distinct()
    rows = rows.join(to, "conversation_id").where("recipient <> created_by")
    key = F.concat_ws(":", F.lit("call"), F.col("id").cast("string"), "recipient")
    return rows.select(key.alias("event_key"), "recipient", F.when(F.coalesce("previews_enabled", F.lit(True)), F.col("created_by")).alias("caller")).dropDuplicates(["event_key"])


def collection_allowed(jobs: DataFrame, subscriptions: DataFrame, closed_users: DataFrame) -> DataFrame:
    """Whether a job may collect: its payer is there, its subscription neither ends nor left the job's plan of payment."""
    rows = jobs.join(subscriptions.select(F.col("id").alias("account_id"), "user_id", F.col("status").alias("state"), "cancel_at_period_end"), "account_id", "left")
    rows = rows.join(closed_users.select("user_id", F.lit(True).alias("closed")), "user_id", "left")
    seats = (F.col("purpose") == "seat") & (F.col("state") == "active")
    renewal = (F.col("purpose") == "renewal") & F.col("state").isin("active", "past_due") & ~F.col("cancel_at_period_end")
    return rows.select("id", F.coalesce(F.col("closed").isNull() & (seats | renewal), F.lit(False)).alias("allowed"))


def recover_jobs(jobs: DataFrame, now: Column, most_attempts: int) -> DataFrame:
    """Leased jobs past their lease: queued again, or failed at the last attempt."""
    late = jobs.where(F.col("locked_s").isNull() | (F.col("locked_s") < now))
    return late.withColumn("new_status", F.when(F.col("attempts") >= most_attempts, "failed").otherwise("queued"))
