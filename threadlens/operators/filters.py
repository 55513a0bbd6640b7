"""Predicates and validity checks: scope, visibility, boundaries, gates; every violated rule of a row is reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed limits of the message contract.
MAX_TEXT_CODE_POINTS = 65_536
MAX_IDENTIFIER_BYTES = 1_024
MAX_SEQUENCE = 2_147_483_647
ROLES = ("user", "assistant")
MAX_INPUT_AGE_MINUTES = 10
MIN_CONFIDENCE = 0.8


def tenant_scope(df: DataFrame, **scope) -> DataFrame:
    """Rows of one company, project, generation...; plain equalities that reach the scan."""
    for column, value in scope.items():
        df = df.where(F.col(column) == F.lit(value))
    return df


def visible(revisions: DataFrame, entries: DataFrame, key: list[str]) -> DataFrame:
    """Revisions with a search entry that are ready or superseded, or that the entry shows as a correction only."""
    met = revisions.join(entries.select(*key, "correction_only"), key)
    return met.where(F.col("status").isin("ready", "superseded") | F.col("correction_only"))


def before_input(candidates: DataFrame, sources: DataFrame, inputs: DataFrame) -> DataFrame:
    """Candidates (request_id, document_id) none of whose sources is of the request's session at or after its input.

    ``sources``: (document_id, session_id, sequence_no); ``inputs``: (request_id, session_id, input_sequence_no).
    The latest source per document and session is all that matters, so sources are reduced before the join.
    """
    last = sources.groupBy("document_id", "session_id").agg(F.max("sequence_no").alias("last_no"))
    late = inputs.join(last, "session_id").where("last_no >= input_sequence_no").select("request_id", "document_id")
    return candidates.join(late, ["request_id", "document_id"], "left_anti")


def searchable(messages: DataFrame, invalidations: DataFrame) -> DataFrame:
    """Messages with text that are searchable, more than progress notes, and that nothing has invalidated."""
    good = messages.where((F.length("text") > 0) & F.col("is_searchable") & (F.col("retention_category") != "progress_only"))
    return good.join(invalidations.select("message_id").distinct(), "message_id", "left_anti")


def row_value_in(df: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key tuple is among ``values``."""
    return df.join(values.select(*keys).distinct(), keys, "left_semi")


def row_value_after(keys: list[str], bounds: list) -> Column:
    """(k1, k2, ...) > (b1, b2, ...), compared from the left."""
    return F.struct(*[F.col(k).alias(f"c{i}") for i, k in enumerate(keys)]) > F.struct(*[F.lit(b).alias(f"c{i}") for i, b in enumerate(bounds)])


def array_overlap(column: str, values: list[str]) -> Column:
    """A non-empty array with a value in common."""
    return (F.size(column) > 0) & F.arrays_overlap(F.col(column), F.array(*[F.lit(v) for v in values]))


def approved(approvals: DataFrame, now: Column) -> DataFrame:
    """Provider approvals in force: active, training disabled, confirmed and terms checked in the past."""
    return approvals.where(F.col("active") & F.col("training_disabled") & (F.col("confirmed_at") <= now) & (F.col("terms_checked_at") <= now))


def fresh(occurred: Column, received: Column, minutes: int = MAX_INPUT_AGE_MINUTES) -> Column:
    """Whether an input is recent enough for an automatic search."""
    return (received.cast("double") - occurred.cast("double")) <= minutes * 60


def high_choice(choice: Column, confidence: Column, least: float = MIN_CONFIDENCE) -> Column:
    """The choice of a confident answer, else null."""
    return F.when(confidence >= least, choice)


def event_violations() -> Column:
    """Codes of all violated rules of an event row; an empty array means valid."""
    def identifier(name: str) -> Column:
        c = F.col(name)
        return F.when(c.isNull() | (F.length(c) == 0) | (F.octet_length(c) > MAX_IDENTIFIER_BYTES) | c.contains("\x00"), f"{name}_invalid")

    rules = [
        identifier("source_session_id"),
        identifier("source_message_id"),
        F.when(F.col("role").isNull() | ~F.col("role").isin(*ROLES), "role_invalid"),
        F.when(F.col("sequence_no").isNull() | (F.col("sequence_no") < 1) | (F.col("sequence_no") > MAX_SEQUENCE), "sequence_invalid"),
        F.when(F.col("revision").isNull() | (F.col("revision") < 1), "revision_invalid"),
        F.when(F.col("text").isNull() | (F.length("text") == 0), "text_empty"),
        F.when(F.length("text") > MAX_TEXT_CODE_POINTS, "text_too_long"),
        F.when(F.col("text").contains("\x00"), "text_has_nul"),
        F.when(F.expr("try_to_timestamp(occurred_at)").isNull() | ~F.col("occurred_at").rlike(r"(?:Z|[+-]\d\d:\d\d)$"), "time_invalid"),
        F.when(F.col("reasoning_effort").isNotNull() & F.col("model_id").isNull(), "effort_without_model"),
    ]
    return F.array_compact(F.array(*rules))


def answer_valid(choice: Column, criteria: Column, probabilities: Column, confidence: Column) -> Column:
    """A judge answer: its choice is a criterion, the probabilities are those of all criteria and sum to one within rounding."""
    p = F.map_values(probabilities)
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    n = F.size(criteria)
    return (
        F.array_contains(criteria, choice)
        & (F.array_sort(F.map_keys(probabilities)) == F.array_sort(criteria))
        & F.forall(p, lambda x: (x >= 0) & (x <= 1))
        & (F.abs(total - 1) <= n * 0.01 / 2 + 1e-9)
        & confidence.between(0, 1)
    )


def embedding_valid(vector: Column, dimensions: int) -> Column:
    """An embedding of the right size, all finite and not all zero."""
    inf = F.lit(float("inf"))
    return (F.size(vector) == dimensions) & F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(vector, lambda x: x != 0)


def public_fields(df: DataFrame) -> DataFrame:
    """Without the columns that begin with an underscore."""
    return df.select(*[c for c in df.columns if not c.startswith("_")])
