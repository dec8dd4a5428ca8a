"""Scalar functions of billing, time and identity, as column expressions. Times are seconds, money is minor units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY, HOUR = 86_400, 3_600
#: Days after which a failed collection is tried again; days of grace after a paid period; seats of a plan.
RETRY_DAYS = (1, 2, 4, 6)
GRACE_DAYS = 7
BUSINESS_SEATS = 19
#: Words of a decline that rule a retry out, and words that allow one.
HARD_DECLINES = ("expired", "stolen", "lost card", "pickup", "pick up", "fraud", "restricted", "revoked", "invalid authorization", "invalid account", "closed account", "authentication required", "do not honor", "do not honour", "not permitted")
SOFT_DECLINES = ("insufficient", "issuer unavailable", "issuer or switch", "processing error", "temporarily", "temporary", "network", "try again", "system error")


def next_month(at: Column, provider: Column, anchor_day: Column) -> Column:
    """The timestamp a month later on the anchor day; one provider stops at day 28, others at the month's last."""
    moved = F.add_months(F.trunc(F.to_date(at), "month"), 1)
    last = F.when(provider == "paystack", 28).otherwise(F.dayofmonth(F.last_day(moved)))
    day = F.least(F.coalesce(anchor_day, F.dayofmonth(at)), last)
    midnight = F.date_add(moved, day - 1).cast("timestamp")
    return F.timestamp_seconds(F.unix_seconds(midnight) + F.unix_seconds(at) - F.unix_seconds(F.date_trunc("day", at)))


def grace_end(paid_through_s: Column, days: int = GRACE_DAYS) -> Column:
    return paid_through_s + days * DAY


def prorated_amount(unit: Column, added: Column, start_us: Column, end_us: Column, now_us: Column) -> Column:
    """The price of added seats for what is left of a period, rounded up; null outside the period.

    The product overflows 64 bits, so it is taken as a decimal and divided without a fraction.
    """
    total = (end_us - start_us).cast("decimal(19,0)")
    product = (unit * added).cast("decimal(17,0)") * (end_us - now_us).cast("decimal(19,0)")
    up = product + total - 1
    inside = (start_us <= now_us) & (now_us < end_us) & (unit >= 1) & (added >= 1)
    return F.when(inside, ((up - F.pmod(up, total)) / total).cast("long"))


def retry_at(due_s: Column, attempts: Column, now_s: Column, deadline_s: Column) -> Column:
    """When a collection is tried again, null after the last retry or at the deadline."""
    days = F.element_at(F.array(*map(F.lit, RETRY_DAYS)), F.when(attempts.between(1, len(RETRY_DAYS)), attempts.cast("int")).otherwise(1))
    at = F.greatest(due_s + days * DAY, now_s + 24 * HOUR)
    return F.when(attempts.between(1, len(RETRY_DAYS)) & (at < deadline_s), at)


def seats_valid(plan: Column, seats: Column) -> Column:
    return (seats >= 1) & F.when(plan == "personal", seats == 1).when(plan == "business", seats <= BUSINESS_SEATS).otherwise(plan == "enterprise")


def subscription_access(status: Column, period_end_s: Column, provider: Column, provider_id: Column, cancels: Column, revoked: Column, now_s: Column) -> Column:
    """Struct (has_access, cutoff_s, grace_s) of a subscription."""
    none = F.lit(None).cast("long")
    graced = provider.isNotNull() & (F.trim(F.coalesce(provider_id, F.lit(""))) != "") & (status != "cancelled") & ~cancels
    grace = F.when(graced, grace_end(period_end_s))
    cutoff = F.coalesce(grace, period_end_s)
    made = lambda a, b, c: F.struct(a.alias("has_access"), b.alias("cutoff_s"), c.alias("grace_s"))
    manual = (status == "active") & provider.isNull() & ~cancels
    return F.when(revoked | ~status.isin("active", "past_due", "cancelled"), made(F.lit(False), none, none)).when(period_end_s.isNull(), made(manual, none, none)).otherwise(made(now_s < cutoff, cutoff, grace))


def restore_deadline(period_end_s: Column, now_s: Column, days: int = 30) -> Column:
    """Until when an account can be restored: a window after the paid period if that isn't over, else after now."""
    return F.greatest(F.coalesce(period_end_s, now_s), now_s) + days * DAY


def tombstone(user_id: Column) -> Column:
    return F.concat(F.lit("deleted:"), F.substring(F.sha2(user_id.cast("string"), 256), 1, 32))


def backoff_seconds(attempts: Column) -> Column:
    """Delay of a redelivery: doubled each time, 300 s at most."""
    return F.least(F.pow(F.lit(2), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(8))), F.lit(300)).cast("long")


def push_backoff_seconds(attempts: Column) -> Column:
    return F.least(F.lit(3600), 30 * F.pow(F.lit(2), F.least(attempts, F.lit(7)))).cast("long")


def preview_text(body: Column, enabled: Column) -> Column:
    return F.when(enabled, F.left(body, F.lit(180)))


def canonical(*fields: Column) -> Column:
    """Fields joined for a hash, missing ones as nothing."""
    return F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])


def join_window(status: Column, start_s: Column, minutes: Column, now_s: Column, early_s: int = 15 * 60) -> Column:
    ends = start_s + minutes * 60
    return F.when(status == "cancelled", "cancelled").when(status == "completed", "completed").when(now_s < start_s - early_s, "too_early").when(now_s >= ends, "expired").otherwise("open")


def decline_retryable(code: Column, message: Column) -> Column:
    """Whether a decline may be tried again: hard words rule it out, soft ones allow it, others don't."""
    text = F.regexp_replace(F.lower(F.concat_ws(" ", code, F.coalesce(message, F.lit("")))), "_", " ")
    return F.when(text.rlike("|".join(HARD_DECLINES)), False).otherwise(text.rlike("|".join(SOFT_DECLINES)))
