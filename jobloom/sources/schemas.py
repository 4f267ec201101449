"""Schemas of the queue's tables; none is ever inferred."""

from __future__ import annotations

JOBS = """
id string, type string, data string, status string, priority int, attempt int, max_attempts int,
dedupe_key string, dedupe_scope string, backoff_strategy string, backoff_base_ms bigint, backoff_cap_ms bigint,
run_at timestamp_ntz, created_at timestamp_ntz, claimed_at timestamp_ntz, completed_at timestamp_ntz, failed_at timestamp_ntz,
fail_reason string, claim_token string
"""
COMMANDS = "seq bigint, ts timestamp_ntz, op string, job_id string, type string, dedupe_key string, dedupe_scope string, data string, token string, reason string, max_attempts int, step_seq int, step_name string"
STEPS = "job_id string, seq int, name string, result string"
EVENTS = "job_id string, type string, kind string, ts timestamp_ntz, duration_ms bigint, attempt int, max_attempts int, terminal boolean, reason string, op string, handled bigint, saturated boolean"
RECEIPTS = "job_id string, token string, op string, outcome string, at timestamp_ntz"
BATCHES = "stream string, batch bigint"



def names(ddl: str) -> list[str]:
    """The columns of a schema."""
    return [f.split()[0] for f in ddl.split(",")]


def as_struct(ddl: str) -> str:
    """A schema as the type of one column."""
    return f"struct<{', '.join(':'.join(f.split()) for f in ddl.split(','))}>"


OPEN = ("pending", "active")
TERMINAL = ("completed", "failed", "superseded")
STATUSES = (*OPEN, *TERMINAL)
#: Columns that callers may see: no token.
PUBLIC = ("id", "type", "data", "status", "priority", "attempt", "max_attempts", "dedupe_key", "dedupe_scope", "run_at", "created_at", "claimed_at", "completed_at", "failed_at", "fail_reason")
