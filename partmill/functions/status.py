"""Status ladders, eligibility and error classification as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import STAGES, STATUS_STAGE
from ..scale import case_map


def delivery_eligibility(product_status, validation_status, approved_for_output, pending) -> Column:
    """review_pending / failed / approved / partial / not_ready, first match wins."""
    approved = F.coalesce(approved_for_output, F.lit(False))
    return (
        F.when((F.coalesce(pending, F.lit(0)) > 0) | (product_status == "REVIEW_REQUIRED"), "review_pending")
        .when((product_status == "FAIL") | F.coalesce(validation_status == "FAIL", F.lit(False)), "failed")
        .when(approved & ((product_status == "APPROVED") | F.coalesce(validation_status == "PASS", F.lit(False))), "approved")
        .when(approved, "partial")
        .when(product_status.isin("APPROVED", "VALIDATED"), "approved")
        .when(product_status == "PARTIAL", "partial")
        .otherwise("not_ready")
    )


def item_status(product_status, pending) -> Column:
    return (
        F.when(product_status.isNull(), "FAILED")
        .when((F.coalesce(pending, F.lit(0)) > 0) | (product_status == "REVIEW_REQUIRED"), "REVIEW_REQUIRED")
        .when(product_status == "FAIL", "FAILED")
        .when(product_status == "NO_AUTHORITATIVE_SOURCE", "REVIEW_REQUIRED")
        .when(product_status.isin("APPROVED", "VALIDATED"), "APPROVED")
        .when(product_status == "PARTIAL", "PARTIAL")
        .when(product_status == "INGESTED", "FAILED")
        .otherwise("PARTIAL")
    )


def stage_rank(status: Column) -> Column:
    return case_map(status, STATUS_STAGE, 0)


def advance_status(current: Column, proposed: Column, stage: str, later_output: Column | None = None) -> Column:
    """Take the stage's status unless a later stage has already set its own."""
    if stage == "understanding":
        return F.when(proposed.isNotNull() & current.isin("INGESTED", "DUPLICATE_CANDIDATE"), proposed).otherwise(current)
    # REVIEW_REQUIRED may come from any stage and never counts as later work.
    rank = F.when(current == "REVIEW_REQUIRED", F.lit(0)).otherwise(stage_rank(current))
    blocked = rank > STAGES.index(stage) + 1
    if later_output is not None:
        blocked = blocked | later_output
    return F.when(proposed.isNull() | blocked, current).otherwise(proposed)


def _contains_any(text: Column, words: list[str]) -> Column:
    expr = F.lit(False)
    for w in words:
        expr = expr | text.contains(w)
    return expr


def is_daily_limit(message: Column) -> Column:
    return _contains_any(F.lower(message), [
        "tokens per day", "tpd", "insufficient credits", "credit limit",
        "quota exceeded", "usage limit"])


def is_rate_limit(message: Column) -> Column:
    return _contains_any(F.lower(message), ["429", "rate_limit", "rate limit"])


def error_class(message: Column, exception_name: Column) -> Column:
    text = F.lower(message)
    return (
        F.when(is_daily_limit(message), "LLM_QUOTA_EXHAUSTED")
        .when(is_rate_limit(message), "LLM_RATE_LIMIT_TPM")
        .when(_contains_any(text, ["timeout", "timed out"]), "LLM_TIMEOUT")
        .when(_contains_any(text, ["connection refused", "errno 61"]), "CONNECTION_REFUSED")
        .when(_contains_any(text, ["validation error", "json", "output parser"]), "LLM_PARSE")
        .otherwise(exception_name)
    )


RETRY_AFTER = r"(?i)try again in\s+(?:(\d+)\s*h)?\s*(?:(\d+)\s*m)?\s*(?:([0-9.]+)\s*s)?"


def retry_delay(message: Column, attempt: Column) -> Column:
    def part(i):
        return F.coalesce(F.regexp_extract(message, RETRY_AFTER, i).try_cast("double"), F.lit(0.0))
    parsed = part(1) * 3600.0 + part(2) * 60.0 + part(3) + 0.25
    cap = F.when(is_daily_limit(message), 120.0).otherwise(60.0)
    return F.when(message.rlike(RETRY_AFTER), F.least(parsed, cap)).otherwise(
        F.least(F.pow(F.lit(2.0), attempt), F.lit(40.0)))


def review_flow_status(validation_status: Column) -> Column:
    return case_map(validation_status, {"PASS": "VALIDATED", "PARTIAL": "PARTIAL",
                                        "REVIEW_REQUIRED": "REVIEW_REQUIRED", "FAIL": "FAIL"}, "PARTIAL")
