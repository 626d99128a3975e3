"""Classification of delivery errors and the state that follows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dwellmatch.functions.redact import mask_token
from dwellmatch.functions.text import regex_first


def classify_error(code: Column, description: Column, retry_after: Column) -> Column:
    """struct(kind, retry_after_ms, error); kind is blocked, permanent, rate_limited or retryable."""
    text = mask_token(F.coalesce(description, F.lit("")))
    positive = lambda c: F.when(c > 0, c)
    seconds = F.coalesce(
        positive(retry_after.cast("long")),
        positive(regex_first(description, r"(?i)retry after\s+(\d+)").cast("long")),
        F.lit(1).cast("long"),
    )
    code = positive(code)
    blocked = (code == 403) & text.rlike("(?i)blocked")
    permanent = (code >= 400) & (code < 500)
    kind = (
        F.when(code == 429, "rate_limited").when(blocked, "blocked").when(permanent, "permanent").otherwise("retryable")
    )
    coded = lambda label: F.concat(F.lit(f"telegram_{label}:"), code.cast("string"), F.lit(":"), text)
    error = (
        F.when(code == 429, F.concat(F.lit("telegram_retry_after:"), seconds.cast("string")))
        .when(blocked, "telegram_bot_blocked")
        .when(permanent, coded("permanent"))
        .when(code >= 500, coded("retryable"))
        .otherwise(F.concat(F.lit("telegram_retryable:"), text))
    )
    return F.struct(
        kind.alias("kind"), F.when(code == 429, seconds * 1000).alias("retry_after_ms"), error.alias("error")
    )


def status_after_error(kind: Column, attempt: Column, max_attempts: int = 5) -> Column:
    """Notification status after one failed attempt (attempts count from 1)."""
    return (
        F.when(kind.isin("blocked", "permanent"), "failed")
        .when(kind == "rate_limited", "pending")
        .when(attempt >= max_attempts, "failed")
        .otherwise("pending")
    )
