"""What a provider's answer means: error classes, when to try again, and what is read from its body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: statuses of a limited rate, and the form of an HTTP date.
LIMITED, HTTP_DATE = (429, 529), "dd MMM yyyy HH:mm:ss"


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds that a Retry-After header asks for: a whole number, or an HTTP date not in the past; null if it is neither. ``now`` in epoch seconds."""
    number = F.when(F.trim(header).rlike("^[0-9]{1,9}$"), F.trim(header).cast("double"))
    date = F.regexp_extract(header, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1)
    # the wall clock of the parsed date, whatever the session's zone, counted from the epoch's
    clock = F.try_to_timestamp(F.nullif(date, F.lit("")), F.lit(HTTP_DATE)).cast("timestamp_ntz")
    when = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), clock).cast("double")
    return F.coalesce(number, F.when(when.isNotNull(), F.greatest(when - now, F.lit(0.0))))


def classified(answers: DataFrame, now: Column) -> DataFrame:
    """``answers`` (status, null if none came; timed_out; retry_after; body) with code (null if fine), retryable, retry_seconds, model, input_tokens, output_tokens.

    Redirects are refused, never followed; a limited rate and server errors may be tried again, when the provider says; anything else that is not a success is
    final, and so is a body that is no JSON object with a model.
    """
    ok = F.col("status").between(200, 299)
    parsed = F.from_json("body", "struct<model:string,usage:struct<input_tokens:bigint,output_tokens:bigint>,answers:map<string,string>>")
    code = (
        F.when(F.col("status").isNull(), F.when(F.col("timed_out"), "provider_timeout").otherwise("provider_unavailable"))
        .when(F.col("status").between(300, 399), "provider_redirect_rejected")
        .when(F.col("status").isin(*LIMITED), "provider_rate_limited")
        .when(F.col("status") >= 500, "provider_unavailable")
        .when(~ok, "provider_rejected")
        .when(parsed["model"].isNull() | (F.length(parsed["model"]) == 0), "provider_contract_invalid")
    )
    retryable = F.coalesce(code.isin("provider_timeout", "provider_unavailable", "provider_rate_limited"), F.lit(False))
    tokens = lambda c: F.when(ok & (parsed["usage"][c] >= 0), parsed["usage"][c]).alias(c)
    return answers.select(
        "*", code.alias("code"), retryable.alias("retryable"), F.when(retryable & F.col("status").isNotNull(), retry_after_seconds(F.col("retry_after"), now)).alias("retry_seconds"), F.when(ok, parsed["model"]).alias("model"), tokens("input_tokens"), tokens("output_tokens")
    )
