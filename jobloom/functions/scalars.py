"""Column functions of the queue: back-off, deterministic ids, receipts, log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the queue's contract.
BACKOFF_BASE_MS, BACKOFF_CAP_MS = 1_000, 60_000
CLAIM_ERROR_CAP_MS = 60_000
LOG_CHARS, LOG_ENTRIES = 4_000, 1_000
LOG_SUFFIX = "… [truncated]"
JOURNAL_BYTES = 8_000_000
#: Bytes of a record's time in JSON, with its name and quotes.
TIME_BYTES = 32
FATAL_ERRORS = ("NonRetryable", "NondeterminismError", "NonSerializableStepResult", "JournalTooLarge", "OrchestrationUnsupportedError")


def backoff_bounds_ms(attempt: Column, strategy: Column, base: Column, cap: Column) -> tuple[Column, Column]:
    """Least and greatest delay before the retry after some attempt.

    Fixed: both are the base, capped. Exponential: the base doubles with each attempt up to the
    cap, the delay is a random share of that, and never less than the base itself.
    """
    base = F.coalesce(base, F.lit(BACKOFF_BASE_MS)).cast("bigint")
    cap = F.coalesce(cap, F.lit(BACKOFF_CAP_MS)).cast("bigint")
    grown = F.least(cap.cast("double"), base * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1))).cast("bigint")
    fixed = F.coalesce(strategy, F.lit("exponential")) == "fixed"
    return F.when(fixed, F.least(cap, base)).otherwise(base), F.when(fixed, F.least(cap, base)).otherwise(F.greatest(base, grown))


def seeded_share(*parts: Column) -> Column:
    """A number in [0, 1) that the parts decide: jitter that a retried task repeats."""
    digest = F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def backoff_ms(attempt: Column, strategy: Column, base: Column, cap: Column, job_id: Column) -> Column:
    """The delay itself, with jitter from the job's id and attempt."""
    low, high = backoff_bounds_ms(attempt, strategy, base, cap)
    fixed = F.coalesce(strategy, F.lit("exponential")) == "fixed"
    return F.when(fixed, low).otherwise(F.greatest(low, F.floor(high * seeded_share(job_id, attempt)))).cast("bigint")


def next_error_backoff_ms(last: Column, cap: int = CLAIM_ERROR_CAP_MS) -> Column:
    """One second, doubled with each error in a row, up to a cap."""
    return F.least(F.lit(cap), F.greatest(F.lit(1_000), 2 * last)).cast("bigint")


def heartbeat_interval_ms(timeout_ms: Column) -> Column:
    """A third of the visibility timeout, one millisecond at least."""
    return F.greatest(F.lit(1), F.floor(timeout_ms / 3)).cast("bigint")


def later_by_ms(ts: Column, ms: Column) -> Column:
    """A timestamp moved on by milliseconds."""
    ms = ms.cast("bigint")
    day = F.lit(86_400_000)
    # both parts are ints, however far the time lies
    return F.timestamp_add("MILLISECOND", (ms % day).cast("int"), F.timestamp_add("DAY", F.floor(ms / day).cast("int") + F.when((ms < 0) & (ms % day != 0), 1).otherwise(0), ts))


def lag_ms(now: Column, oldest: Column) -> Column:
    """Milliseconds from oldest to now, 0 when there is none or it lies ahead."""
    return F.coalesce(F.greatest(F.lit(0), F.timestamp_diff("MILLISECOND", oldest, now)), F.lit(0)).cast("bigint")


def derived_uuid(seed: Column, label: Column) -> Column:
    """A version-4 shaped id from SHA-256 of seed, a zero byte, and label."""
    h = F.sha2(F.concat(seed, F.lit("\0"), label), 256)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def idempotency_key(job_id: Column, seq: Column, name: Column, given: Column | None = None) -> Column:
    """The key that a step passes on to what it calls; a given one wins."""
    own = F.concat_ws(":", job_id, seq.cast("string"), name)
    return own if given is None else F.coalesce(given, own)


def receipt_key(token: Column) -> Column:
    """Key under which the result of a terminal write is kept; unfenced writes share one."""
    url = F.translate(F.base64(F.encode(token, "UTF-8")), "+/=\r\n", "-_")
    return F.when(token.isNull(), F.lit("unfenced")).otherwise(F.concat(F.lit("token_"), url))


def truncated_log(message: Column, most: int = LOG_CHARS) -> Column:
    """A log line of at most so many UTF-16 units, marked where it was cut, never within a character."""
    units = F.encode(message, "UTF-16BE")
    room = 2 * max(0, most - len(LOG_SUFFIX))
    # the last unit that fits may be the first half of a character
    half = F.hex(F.substring(units, max(1, room - 1), 1)).between("D8", "DB")
    kept = F.when(half, F.substring(units, 1, max(0, room - 2))).otherwise(F.substring(units, 1, room))
    return F.when(F.octet_length(units) > 2 * most, F.concat(F.decode(kept, "UTF-16BE"), F.lit(LOG_SUFFIX))).otherwise(message)


def record_bytes(seq: Column, name: Column, result: Column) -> Column:
    """Size of a journal record: UTF-8 bytes of its JSON, the time of its writing included; never less than its length in characters."""
    fields = F.struct(seq.alias("seq"), name.alias("name"), result.alias("result"))
    return (F.octet_length(F.to_json(fields, {"ignoreNullFields": "false"})) + TIME_BYTES).cast("bigint")


def is_fatal(error: Column) -> Column:
    """Errors of the step journal that no retry can mend."""
    return F.coalesce(error.isin(*FATAL_ERRORS), F.lit(False))
