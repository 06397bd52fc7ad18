"""Text jobs: validation, rule-based extraction, routing and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightwater.functions import fixed_values as fixed
from brightwater.functions.text import first_match, is_blank, plain_spaces, trimmed

# Amounts that may have thousands separators.
AMOUNT_WITH_COMMAS_PATTERN = (
    r"(?i)(?:total|amount)[:\s$€£]*([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]{1,2})?|[0-9]+(?:\.[0-9]{1,2})?)"
)


def _body_bytes() -> Column:
    """Bytes of the job as JSON; ``input_json`` is JSON text already."""
    given = F.to_json(F.struct("pipeline_type", "input_text"))
    raw = F.coalesce(F.octet_length("input_json") + len(',"input_json":'), F.lit(0))
    return F.octet_length(given) + raw


def validate_jobs(jobs: DataFrame, max_bytes: int = fixed.MAX_JOB_BYTES) -> DataFrame:
    """Add ``error``, null for a valid job; the first failing check decides."""
    kind = F.col("pipeline_type")
    size = _body_bytes()
    error = (
        F.when(F.coalesce(kind, F.lit("")) == "", "Missing required field: pipeline_type.")
        .when(
            ~kind.isin(fixed.JOB_PIPELINES),
            F.concat(
                F.lit('Invalid pipeline_type "'),
                kind,
                F.lit(f'". Valid values: {", ".join(fixed.JOB_PIPELINES)}.'),
            ),
        )
        .when(
            F.col("input_text").isNull() & F.col("input_json").isNull(),
            "Provide either input_text or input_json.",
        )
        .when(
            size > max_bytes,
            F.concat(
                F.lit("Input size "),
                size.cast("string"),
                F.lit(f" bytes exceeds the {max_bytes // 1024}KB limit ({max_bytes} bytes)."),
            ),
        )
    )
    return jobs.withColumn("error", error)


def job_text() -> Column:
    """The text a job is processed on."""
    return F.coalesce(F.col("input_text"), F.col("input_json"), F.lit('""'))


def invoice_fields(text: Column, today: Column, fix_thousands: bool = False) -> dict[str, Column]:
    """Vendor, amount, currency, date and confidence read by pattern.

    The amount stops at a thousands comma, and "Subtotal" counts as a total; ``fix_thousands``
    accepts the commas.
    """
    plain = plain_spaces(text)
    if fix_thousands:
        digits = F.replace(first_match(plain, AMOUNT_WITH_COMMAS_PATTERN), F.lit(","), F.lit(""))
    else:
        digits = first_match(plain, fixed.AMOUNT_PATTERN)
    amount = F.coalesce(digits.cast("double"), F.lit(0.0))
    vendor = trimmed(first_match(plain, fixed.VENDOR_PATTERN))
    return {
        "vendor": F.coalesce(vendor, F.lit("Unknown")),
        "amount": amount,
        "currency": F.when(F.contains(text, F.lit("€")), "EUR")
        .when(F.contains(text, F.lit("£")), "GBP")
        .otherwise("USD"),
        "date": F.coalesce(first_match(plain, fixed.DATE_PATTERN), today.cast("string")),
        "confidence": F.when(amount > 0, 0.6).otherwise(0.3),
    }


def extract_invoice(
    jobs: DataFrame, today: Column, text: str = "input_text", fix_thousands: bool = False
) -> DataFrame:
    return jobs.withColumns(invoice_fields(F.col(text), today, fix_thousands))


def email_fields(text: Column) -> dict[str, Column]:
    category = (
        F.when(text.rlike("(?i)complaint|refund"), "complaint")
        .when(text.rlike("(?i)support|help"), "support")
        .otherwise("other")
    )
    return {
        "category": category,
        "intent": F.lit("unknown"),
        "sender": F.lit("unknown@example.com"),
        "summary": F.substring(text, 1, 100),
        "confidence": F.lit(0.5),
    }


def classify_email(jobs: DataFrame, text: str = "input_text") -> DataFrame:
    return jobs.withColumns(email_fields(F.col(text)))


def ticket_fields(text: Column) -> dict[str, Column]:
    return {
        "category": F.when(text.rlike("(?i)billing|payment"), "billing")
        .when(text.rlike("(?i)bug|error"), "technical")
        .otherwise("general"),
        "priority": F.when(text.rlike("(?i)urgent|critical"), "critical").otherwise("medium"),
        "routing": F.lit("general-support"),
        "summary": F.substring(text, 1, 100),
        "confidence": F.lit(0.5),
    }


def categorize_ticket(jobs: DataFrame, text: str = "input_text") -> DataFrame:
    return jobs.withColumns(ticket_fields(F.col(text)))


def email_urgency(jobs: DataFrame, text: str = "input_text") -> DataFrame:
    """Add ``urgency`` by the stated keywords."""

    def has(keywords: list[str]) -> Column:
        return F.col(text).rlike("(?i)" + "|".join(keywords))

    urgency = (
        F.when(has(fixed.URGENCY_HIGH), "high")
        .when(has(fixed.URGENCY_MEDIUM), "medium")
        .otherwise("low")
    )
    return jobs.withColumn("urgency", urgency)


def route_jobs(jobs: DataFrame, today: Column) -> DataFrame:
    """Process each job by its kind in one pass over the table.

    Adds ``status``, ``error`` and one result struct per kind (``invoice``, ``email``, ``ticket``),
    null for the other kinds. An unsupported kind fails.
    """
    text = job_text()
    kind = F.col("pipeline_type")
    invoice, email, ticket = fixed.JOB_PIPELINES

    def when_kind(name: str, fields: dict[str, Column]) -> Column:
        return F.when(kind == name, F.struct(*[c.alias(n) for n, c in fields.items()]))

    supported = F.coalesce(kind.isin(fixed.JOB_PIPELINES), F.lit(False))
    return jobs.withColumns(
        {
            "status": F.when(supported, "completed").otherwise("failed"),
            "error": F.when(
                ~supported,
                F.concat(
                    F.lit("Unsupported pipeline type: "), F.coalesce(kind, F.lit("undefined"))
                ),
            ),
            "invoice": when_kind(invoice, invoice_fields(text, today)),
            "email": when_kind(email, email_fields(text)),
            "ticket": when_kind(ticket, ticket_fields(text)),
        }
    )


def job_results(routed: DataFrame, kind: str) -> DataFrame:
    """The result table of one kind: ``invoice``, ``email`` or ``ticket``."""
    return routed.filter(F.col(kind).isNotNull()).select("job_id", f"{kind}.*")


def detect_tool_intent(messages: DataFrame, text: str = "message") -> DataFrame:
    """Add ``tool`` (null: answer by retrieval), ``to``, ``subject`` and ``body``.

    An e-mail phrase without an address is no tool call, even if the message also asks for a
    record to be written.
    """
    message = F.col(text)
    lowered = F.lower(message)

    def mentions(phrases: list[str]) -> Column:
        found = F.lit(False)
        for phrase in phrases:
            found = found | F.contains(lowered, F.lit(phrase))
        return found

    plain = F.regexp_replace(message, r"[\t\x0B\f\r\x{A0}]", " ")
    address = first_match(plain, fixed.RECIPIENT_PATTERN)
    wants_email = mentions(fixed.EMAIL_PHRASES)
    email = wants_email & address.isNotNull()
    record = ~wants_email & mentions(fixed.RECORD_PHRASES)
    subject = F.coalesce(
        trimmed(first_match(plain, fixed.SUBJECT_PATTERN)), F.lit(fixed.DEFAULT_SUBJECT)
    )
    body = F.concat(F.lit(fixed.EMAIL_BODY_BEFORE), message, F.lit(fixed.EMAIL_BODY_AFTER))
    return messages.withColumns(
        {
            "tool": F.when(email, "send_email").when(record, "write_db_record"),
            "to": F.when(email, address),
            "subject": F.when(email, subject),
            "body": F.when(email, body).when(record, message),
        }
    )


def validate_summary(summaries: DataFrame) -> DataFrame:
    """Add ``error`` to (summary, highlights): a summary is needed, and three to seven highlights."""
    count = F.coalesce(F.size("highlights"), F.lit(0))
    error = F.when(is_blank(F.col("summary")), "LLM returned an empty summary.").when(
        ~count.between(3, 7),
        F.concat(
            F.lit("LLM returned "), count.cast("string"), F.lit(" highlights; expected 3–7.")
        ),
    )
    return summaries.withColumn("error", error)


def qa_result_status(replies: DataFrame) -> DataFrame:
    """Add ``answer`` and ``found`` to stored replies (question, transcript, reply)."""
    raw = trimmed(F.coalesce("reply", F.lit("")))
    unasked = is_blank(F.col("question")) | is_blank(F.col("transcript"))
    missing = (raw == "") | (raw == fixed.NOT_FOUND_REPLY)
    return replies.withColumns(
        {
            "answer": F.when(unasked, "").when(missing, fixed.NOT_FOUND_ANSWER).otherwise(raw),
            "found": ~unasked & ~missing,
        }
    )


def auto_reply_render(emails: DataFrame) -> DataFrame:
    """The outbox: a reply for every e-mail (category, sender, summary) with a real sender."""
    templates = emails.sparkSession.createDataFrame(
        [(c, subject, body) for c, (subject, body) in fixed.AUTO_REPLIES.items()],
        "template string, subject string, body string",
    )
    known = F.when(F.col("category").isin(list(fixed.AUTO_REPLIES)), F.col("category"))
    sender = F.col("sender")
    addressed = emails.filter(
        F.contains(sender, F.lit("@")) & ~F.startswith(sender, F.lit("unknown"))
    ).withColumn("template", F.coalesce(known, F.lit("other")))
    return (
        addressed.join(F.broadcast(templates), "template")
        .withColumn("body", F.replace("body", F.lit("%s"), F.coalesce("summary", F.lit(""))))
        .drop("template")
    )
