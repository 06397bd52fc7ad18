"""Guard rails: injection and content patterns, roles, tools, and the combined screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightwater.functions import fixed_values as fixed
from brightwater.functions.text import plain_spaces
from brightwater.operators.limiter import rate_limit_batch


def injection_pattern(text: Column) -> Column:
    """Number of the first injection pattern that matches, null if none does."""
    plain = plain_spaces(text)
    first = F.when(plain.rlike(fixed.INJECTION_PATTERNS[0]), F.lit(0))
    for number, pattern in enumerate(fixed.INJECTION_PATTERNS[1:], start=1):
        first = first.when(plain.rlike(pattern), F.lit(number))
    return first


def injection_reason(text: Column) -> Column:
    """Why an input is unsafe, null if it is safe. Patterns come before the length limit."""
    return F.when(injection_pattern(text).isNotNull(), fixed.INJECTION_REASON).when(
        F.length(text) > fixed.MAX_INPUT_CHARS, fixed.TOO_LONG_REASON
    )


def moderation_reason(text: Column) -> Column:
    """The policy violation, null if the content is allowed."""
    plain = plain_spaces(text)
    blocked = F.lit(False)
    for pattern in fixed.BLOCKED_CONTENT:
        blocked = blocked | plain.rlike(pattern)
    return F.when(blocked, fixed.MODERATION_REASON)


def detect_prompt_injection(df: DataFrame, text: str = "input") -> DataFrame:
    """Add ``pattern_id``, ``safe`` and ``reason``."""
    found = df.withColumn("pattern_id", injection_pattern(F.col(text)))
    reason = F.when(F.col("pattern_id").isNotNull(), fixed.INJECTION_REASON).when(
        F.length(text) > fixed.MAX_INPUT_CHARS, fixed.TOO_LONG_REASON
    )
    return found.withColumn("reason", reason).withColumn("safe", F.col("reason").isNull())


def moderate_content(df: DataFrame, text: str = "input") -> DataFrame:
    """Add ``allowed`` and ``reason``."""
    return df.withColumn("reason", moderation_reason(F.col(text))).withColumn(
        "allowed", F.col("reason").isNull()
    )


def role_table(spark) -> DataFrame:
    rows = [(role, action) for role, actions in fixed.ROLE_ACTIONS.items() for action in actions]
    return spark.createDataFrame(rows, "role string, action string")


def rbac_filter(df: DataFrame) -> DataFrame:
    """Add ``permitted``: whether the row's role may take its action; an unknown role may not."""
    allowed = role_table(df.sparkSession).withColumn("_allowed", F.lit(True))
    return (
        df.join(F.broadcast(allowed), ["role", "action"], "left")
        .withColumn("permitted", F.coalesce("_allowed", F.lit(False)))
        .drop("_allowed")
    )


def tool_authorize(calls: DataFrame) -> DataFrame:
    """Add ``authorized`` and ``message`` to calls (user_id, tool, owner_id, allowed_tools)."""
    message = F.when(
        ~F.col("user_id").eqNullSafe(F.col("owner_id")), "Permission denied: user mismatch"
    ).when(
        ~F.coalesce(F.array_contains("allowed_tools", F.col("tool")), F.lit(False)),
        F.concat(
            F.lit('Permission denied: user does not have permission to use tool "'),
            F.col("tool"),
            F.lit('"'),
        ),
    )
    return calls.withColumn("message", message).withColumn("authorized", message.isNull())


def security_screen(
    requests: DataFrame,
    limit: int = fixed.REQUESTS_PER_WINDOW,
    window_ms: int = fixed.RATE_WINDOW_MS,
) -> DataFrame:
    """Screen requests (id, project, user_id, role, action, input, ts_ms) in the fixed order.

    Rate limit, role, injection, content: the first failure sets ``status_code`` and ``reason``;
    ``event_type`` and ``severity`` say what to log. A denied role is not logged.
    """
    limited = rate_limit_batch(requests, limit, window_ms)
    checked = rbac_filter(limited).withColumns(
        {
            "_injection": injection_reason(F.col("input")),
            "_moderation": moderation_reason(F.col("input")),
        }
    )
    rejected, denied = ~F.col("allowed"), ~F.col("permitted")
    injected, blocked = F.col("_injection").isNotNull(), F.col("_moderation").isNotNull()

    def first(rate, role, injection, moderation) -> Column:
        return (
            F.when(rejected, rate)
            .when(denied, role)
            .when(injected, injection)
            .when(blocked, moderation)
        )

    nothing = F.lit(None).cast("string")
    return checked.select(
        "id",
        "project",
        "user_id",
        "ts_ms",
        "input",
        first(429, 403, 400, 400).isNull().alias("passed"),
        first(429, 403, 400, 400).alias("status_code"),
        first(
            F.concat(
                F.lit("Rate limit exceeded. Try again in "),
                F.col("reset_in").cast("string"),
                F.lit("s"),
            ),
            F.concat(
                F.lit("Insufficient permissions for action '"), F.col("action"), F.lit("'")
            ),
            F.col("_injection"),
            F.col("_moderation"),
        ).alias("reason"),
        first(
            F.lit("rate_limit"), nothing, F.lit("injection_attempt"), F.lit("abuse")
        ).alias("event_type"),
        first(F.lit("medium"), nothing, F.lit("high"), F.lit("critical")).alias("severity"),
    )


def security_events(screened: DataFrame) -> DataFrame:
    """The event rows to log: the input appears only as a short hash of its first 500 characters."""
    reason = F.when(F.col("event_type") == "rate_limit", "Rate limit exceeded").otherwise(
        F.col("reason")
    )
    return screened.filter(F.col("event_type").isNotNull()).select(
        "project",
        "event_type",
        "user_id",
        input_hash(F.col("input")).alias("input_hash"),
        reason.alias("reason"),
        "severity",
        F.timestamp_millis("ts_ms").alias("created_at"),
    )


def input_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.substring(text, 1, 500), 256), 1, 16)
