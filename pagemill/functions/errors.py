"""Classes of error messages (P10-P13, P19) as column expressions.

Lists hold fixed values. Job and provider classes lower-case the message first, the chunk class does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERMANENT = ("invalid api key", "authentication failed", "unauthorized", "forbidden", "unsupported language", "invalid request", "malformed")
TRANSIENT = ("litellm status 429", "rate limit", "timeout", "timed out", "connection reset", "connection refused", "service unavailable", "temporarily unavailable")
CHUNK_RATE_LIMIT = ("litellm status 429", "rate limit", "rate_limit")
CHUNK_NETWORK = ("context deadline exceeded", "Client.Timeout exceeded", "net/http: request canceled", "connection timed out", "connection reset by peer", "connection refused", "i/o timeout", "timed out", "timeout")
TRANSIENT_STATUS = (429, 502, 503, 504)
PROVIDER_TRANSIENT = ("context deadline exceeded", "client.timeout exceeded", "connection reset", "connection refused", "i/o timeout", "timed out", "timeout", "rate limit", "rate_limit", "temporarily unavailable", "service unavailable", "bad gateway", "gateway timeout")


def holds_any(c: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | c.contains(p)
    return F.coalesce(found, F.lit(False))


def classify_job_error(message: Column) -> Column:
    """permanent, transient or unknown; permanent wins."""
    low = F.lower(message)
    return F.when(holds_any(low, PERMANENT), "permanent").when(holds_any(low, TRANSIENT), "transient").otherwise("unknown")


def classify_chunk_error(message: Column) -> Column:
    """network_timeout, rate_limit or '' (not worth a retry). Case counts."""
    return F.when(holds_any(message, CHUNK_NETWORK), "network_timeout").when(holds_any(message, CHUNK_RATE_LIMIT), "rate_limit").otherwise("")


def is_provider_transient(status: Column, message: Column) -> Column:
    """By HTTP status where there is one, else by phrase."""
    return F.when(status.isNotNull(), status.isin(*TRANSIENT_STATUS)).otherwise(holds_any(F.lower(message), PROVIDER_TRANSIENT))


def timeout_reason(message: Column, typed: Column | None = None) -> Column:
    """gateway_timeout, client_timeout, context_deadline or ''; a reason logged by type comes first."""
    low = F.lower(message)
    known = F.nullif(typed, F.lit("")) if typed is not None else F.lit(None).cast("string")
    by_text = (
        F.when(holds_any(low, ("gateway timeout", "status 504")), "gateway_timeout")
        .when(holds_any(low, ("client.timeout exceeded", "i/o timeout", "timed out")), "client_timeout")
        .when(holds_any(low, ("context deadline exceeded",)), "context_deadline")
        .otherwise("")
    )
    return F.coalesce(known, by_text)


def failover_reason(reason: Column) -> Column:
    return F.when(reason != "", F.concat(F.lit("timeout_"), reason)).otherwise("provider_error")


def failure_category(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(low == "", "interrupted")
        .when(low.contains("timeout"), "timed_out")
        .when(holds_any(low, ("network", "fetch")), "connection_interrupted")
        .when(holds_any(low, ("retry", "circuit")), "provider_could_not_complete")
        .otherwise("translation_failed")
    )


def help_class(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(low.contains("unsupported api version"), "version_mismatch")
        .when(holds_any(low, ("failed to fetch", "networkerror", "network error")), "unreachable")
        .when(low.contains("http 5"), "server_error")
    )
