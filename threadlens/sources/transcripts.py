"""Transcript sources: lines of several chat tools' logs as one record shape, by column expressions.

Every parser takes a frame with ``line`` (and file, line_no where order matters) and adds ``record``, a struct of RECORD's fields:
kind is message, session, ignored (known, not collected), unknown (not understood) or invalid (not JSON).
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = {
    "kind": "string", "source_session_id": "string", "transcript_version": "string", "source_message_id": "string", "occurred_at": "string",
    "role": "string", "model_id": "string", "reasoning_effort": "string", "client_version": "string", "text": "string",
}


def _record(kind: Column, **fields: Column) -> Column:
    """The record struct; all fields but the kind are null unless it is a message or session."""
    given = (kind == "message") | (kind == "session")
    return F.struct(kind.alias("kind"), *[F.when(given, fields[n]).cast(t).alias(n) if n in fields else F.lit(None).cast(t).alias(n) for n, t in RECORD.items() if n != "kind"])


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, path: str, kind: str) -> Column:
    """Whether the value at a path has a JSON type (as schema_of_variant names it)."""
    got = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.coalesce(got.startswith(kind), F.lit(False))


def _parsed(df: DataFrame) -> DataFrame:
    return df.withColumn("__v", F.try_parse_json("line"))


def _blocks_text(v: Column, path: str, tag: str = "text") -> Column:
    """The joined texts of an array's blocks of a type; null if there is none."""
    blocks = F.from_json(F.to_json(F.try_variant_get(v, path, "variant")), "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == tag) & b["text"].isNotNull()), lambda b: b["text"])
    return F.when(F.size(texts) > 0, F.array_join(texts, ""))


def parse_claude(df: DataFrame) -> DataFrame:
    """Lines of one message each; meta, summary, side-chain, error and tool lines are ignored."""
    v = F.col("__v")
    kind = _get(v, "$.type")
    flag = lambda name: F.coalesce(_get(v, f"$.{name}", "boolean"), F.lit(False)) & _is(v, f"$.{name}", "BOOLEAN")
    has = lambda name: F.try_variant_get(v, f"$.{name}", "variant").isNotNull()
    content_list = _is(v, "$.message.content", "ARRAY")
    block_types = F.from_json(F.to_json(F.try_variant_get(v, "$.message.content", "variant")), "array<struct<type:string>>")
    tool = content_list & F.coalesce(F.exists(block_types, lambda b: b["type"] == "tool_result"), F.lit(False))
    whole = F.when(_is(v, "$.message.content", "STRING"), F.nullif(_get(v, "$.message.content"), F.lit("")))
    text = F.when(tool, None).when(content_list, _blocks_text(v, "$.message.content")).otherwise(whole)
    named = F.lit(True)
    for name in ("sessionId", "uuid", "timestamp", "version"):
        named = named & _is(v, f"$.{name}", "STRING")
    state = (
        F.when(v.isNull(), "invalid")
        .when(~_is(v, "$.type", "STRING"), "unknown")
        .when(kind.isin("system", "attachment", "queue-operation"), "ignored")
        .when(~kind.isin("user", "assistant") | ~_is(v, "$.message", "OBJECT"), "unknown")
        .when(flag("isMeta") | flag("isCompactSummary") | flag("isSidechain") | flag("isApiErrorMessage") | has("toolUseResult") | has("sourceToolAssistantUUID"), "ignored")
        .when(~named, "unknown")
        .when(text.isNull(), "ignored")
        .otherwise("message")
    )
    model = F.when((kind == "assistant") & _is(v, "$.message.model", "STRING"), F.nullif(_get(v, "$.message.model"), F.lit("<synthetic>")))
    effort = F.when(model.isNotNull() & _is(v, "$.effort", "STRING"), _get(v, "$.effort"))
    record = _record(
        state, source_session_id=_get(v, "$.sessionId"), transcript_version=_get(v, "$.version"), source_message_id=_get(v, "$.uuid"), occurred_at=_get(v, "$.timestamp"), role=kind, model_id=model, reasoning_effort=effort, text=text
    )
    return _parsed(df).withColumn("record", record).drop("__v")


def codex_turns(df: DataFrame) -> DataFrame:
    """(file, turn_id, model_id, reasoning_effort): the last turn context of each turn. Lines are cut by substring before they are parsed."""
    v = F.col("__v")
    rows = _parsed(df.where(F.col("line").contains('"turn_context"'))).where((_get(v, "$.type") == "turn_context") & _is(v, "$.payload.turn_id", "STRING") & _is(v, "$.payload.model", "STRING"))
    effort = F.when(_is(v, "$.payload.effort", "STRING"), _get(v, "$.payload.effort"))
    rows = rows.select("file", _get(v, "$.payload.turn_id").alias("turn_id"), "line_no", F.struct(_get(v, "$.payload.model").alias("model_id"), effort.alias("reasoning_effort")).alias("c"))
    return rows.groupBy("file", "turn_id").agg(F.max_by("c", "line_no").alias("c")).select("file", "turn_id", "c.*")


def parse_codex(df: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """Event lines; final answers get their turn's model and effort from ``turns``."""
    v = F.col("__v")
    kind, item, role = _get(v, "$.type"), _get(v, "$.payload.item.type"), F.when(_get(v, "$.payload.item.type") == "UserMessage", "user").otherwise("assistant")
    text = F.when(item == "UserMessage", _blocks_text(v, "$.payload.item.content", "text")).otherwise(_blocks_text(v, "$.payload.item.content", "Text"))
    turn = F.when(_is(v, "$.payload.turn_id", "STRING"), _get(v, "$.payload.turn_id"))
    session = _is(v, "$.payload.id", "STRING") & _is(v, "$.payload.cli_version", "STRING")
    named = _is(v, "$.payload.item", "OBJECT") & _is(v, "$.payload.thread_id", "STRING") & _is(v, "$.payload.item.id", "STRING") & _is(v, "$.timestamp", "STRING") & _is(v, "$.payload.item.type", "STRING")
    state = (
        F.when(v.isNull(), "invalid")
        .when(~_is(v, "$.type", "STRING"), "unknown")
        .when(kind.isin("response_item", "turn_context", "token_usage_record", "world_state", "compacted"), "ignored")
        .when(kind == "session_meta", F.when(session, "session").otherwise("unknown"))
        .when((kind != "event_msg") | ~_is(v, "$.payload", "OBJECT"), "unknown")
        .when(F.coalesce(_get(v, "$.payload.type") != "item_completed", F.lit(True)), "ignored")
        .when(~named, "unknown")
        .when(~item.isin("UserMessage", "AgentMessage"), "ignored")
        .when((item == "AgentMessage") & F.coalesce(_get(v, "$.payload.item.phase") != "final_answer", F.lit(True)), "ignored")
        .when(text.isNull(), "ignored")
        .otherwise("message")
    )
    rows = _parsed(df).withColumn("__turn", turn)
    if turns is not None:
        rows = rows.join(turns.withColumnRenamed("turn_id", "__turn"), ["file", "__turn"], "left")
    else:
        rows = rows.withColumns({"model_id": F.lit(None).cast("string"), "reasoning_effort": F.lit(None).cast("string")})
    answer = role == "assistant"
    in_session = kind == "session_meta"
    record = _record(
        state,
        source_session_id=F.when(in_session, _get(v, "$.payload.id")).otherwise(_get(v, "$.payload.thread_id")),
        transcript_version=F.when(in_session, _get(v, "$.payload.cli_version")),
        source_message_id=F.when(~in_session, F.when(F.col("__turn").isNotNull(), F.concat(F.lit("turn:"), F.col("__turn"), F.lit(":"), role)).otherwise(_get(v, "$.payload.item.id"))),
        occurred_at=F.when(~in_session, _get(v, "$.timestamp")),
        role=F.when(~in_session, role),
        model_id=F.when(answer & ~in_session, F.col("model_id")),
        reasoning_effort=F.when(answer & ~in_session, F.col("reasoning_effort")),
        text=F.when(~in_session, text),
    )
    return rows.withColumn("record", record).drop("__v", "__turn", "model_id", "reasoning_effort")


def parse_cursor(df: DataFrame) -> DataFrame:
    """Hook payloads of two events; ``hook`` is null where the payload isn't one of them."""
    v = F.col("__v")
    event = _get(v, "$.hook_event_name")
    roots = F.from_json(F.to_json(F.try_variant_get(v, "$.workspace_roots", "variant")), "array<string>")
    params = F.from_json(F.to_json(F.try_variant_get(v, "$.model_params", "variant")), "array<struct<id:string,value:string>>")
    effort = F.filter(params, lambda p: p["id"] == "effort")[0]["value"]
    good = F.lit(True)
    for name in ("conversation_id", "generation_id", "model", "cursor_version"):
        good = good & _is(v, f"$.{name}", "STRING") & (F.length(_get(v, f"$.{name}")) > 0)
    good = good & (F.size(roots) > 0) & F.forall(roots, lambda r: F.length(r) > 0)
    good = good & (((event == "beforeSubmitPrompt") & _is(v, "$.prompt", "STRING")) | ((event == "afterAgentResponse") & _is(v, "$.text", "STRING")))
    hook = F.struct(
        _get(v, "$.conversation_id").alias("session_id"),
        _get(v, "$.generation_id").alias("generation_id"),
        event.alias("hook_event_name"),
        roots.alias("workspace_roots"),
        F.coalesce(_get(v, "$.model_id"), _get(v, "$.model")).alias("model_id"),
        F.nullif(effort, F.lit("")).alias("reasoning_effort"),
        _get(v, "$.cursor_version").alias("client_version"),
        F.when(event == "beforeSubmitPrompt", _get(v, "$.prompt")).alias("prompt"),
        F.when(event == "afterAgentResponse", _get(v, "$.text")).alias("text"),
    )
    return _parsed(df).withColumn("hook", F.when(F.coalesce(good, F.lit(False)), hook)).drop("__v")


def parse_deepseek(df: DataFrame, repository: str | None = None) -> DataFrame:
    """Records of a log whose answers become final at the turn's end: of each completed turn only the last text stays.

    Columns file, line_no, line. State runs along each file: the session and its settings are carried forward by windows, a
    turn's last answer is the latest before its end.
    """
    v = F.col("__v")
    kind = _get(v, "$.type")
    rows = _parsed(df).withColumn("__kind", kind)
    ahead = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_session = kind == "session"
    fine = _is(v, "$.id", "STRING") & _is(v, "$.cwd", "STRING") & _get(v, "$.version", "int").isin(3, 4) & (_get(v, "$.delegationDepth", "int") == 0) & (_get(v, "$.isSeeded", "boolean") == F.lit(False))
    if repository is not None:
        fine = fine & (_get(v, "$.cwd") == repository)
    opened = F.struct(F.when(F.coalesce(fine, F.lit(False)), _get(v, "$.id")).alias("id"), _get(v, "$.version").alias("version"), F.col("line_no").alias("at"))
    rows = rows.withColumn("__session", F.last(F.when(is_session, opened), ignorenulls=True).over(ahead))
    block = Window.partitionBy("file", "__session.at").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    setting = F.struct(F.when(_is(v, "$.data.header.config.reasoningEffort", "STRING"), _get(v, "$.data.header.config.reasoningEffort")).alias("effort"))
    rows = rows.withColumn("__effort", F.last(F.when(kind == "request/header", setting), ignorenulls=True).over(block)["effort"])
    when = F.date_format(F.timestamp_millis(_get(v, "$.time", "bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    turn = _get(v, "$.data.turn")
    said = _blocks_text(v, "$.data.message.content")
    answer = (kind == "assistant/message") & (_get(v, "$.data.message.role") == "assistant") & (_get(v, "$.data.message.source.kind") == "model") & _is(v, "$.data.message.id", "STRING") & turn.isNotNull() & said.isNotNull() & when.isNotNull()
    model = F.when(_is(v, "$.data.message.source.model", "STRING"), _get(v, "$.data.message.source.model"))
    pending = F.struct(
        _get(v, "$.data.message.id").alias("id"), when.alias("at"), model.alias("model"), F.when(model.isNotNull(), F.col("__effort")).alias("effort"), said.alias("text"), F.col("line_no").alias("n")
    )
    by_turn = Window.partitionBy("file", "__session.at", turn).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__last_end", F.max(F.when(kind == "turn/end", F.col("line_no"))).over(by_turn)).withColumn("__answer", F.last(F.when(answer, pending), ignorenulls=True).over(by_turn))
    ready = (kind == "turn/end") & (_get(v, "$.data.reason.kind") == "completed") & F.col("__answer").isNotNull() & (F.col("__answer.n") > F.coalesce("__last_end", F.lit(-1)))
    asked = _blocks_text(v, "$.data.content")
    question = (kind == "user/message") & (_get(v, "$.data.role") == "user") & (_get(v, "$.data.source.kind") == "user") & _is(v, "$.data.id", "STRING") & asked.isNotNull() & when.isNotNull()
    live = F.col("__session.id").isNotNull()
    state = F.when(v.isNull(), "invalid").when(is_session & live, "session").when(live & (ready | question), "message").otherwise("ignored")
    user = kind == "user/message"
    message = kind != "session"
    record = _record(
        state,
        source_session_id=F.col("__session.id"),
        transcript_version=F.col("__session.version"),
        source_message_id=F.when(user, _get(v, "$.data.id")).when(message, F.col("__answer.id")),
        occurred_at=F.when(user, when).when(message, F.col("__answer.at")),
        role=F.when(user, "user").when(message, "assistant"),
        model_id=F.when(~user & message, F.col("__answer.model")),
        reasoning_effort=F.when(~user & message, F.col("__answer.effort")),
        text=F.when(user, asked).when(message, F.col("__answer.text")),
    )
    return rows.withColumn("record", record).select(*df.columns, "record")


def zstd_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of files of concatenated zstd frames."""
    return unpacked_lines(spark.read.format("binaryFile").load(path).select("path", "content"))


def unpacked_lines(files: DataFrame) -> DataFrame:
    """Lines of (path, content): frames up to the first broken one; an unfinished last line is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                out, rest = io.BytesIO(), bytes(content)
                while rest:
                    d = zstandard.ZstdDecompressor().decompressobj()
                    try:
                        part = d.decompress(rest)
                    except zstandard.ZstdError:
                        break
                    out.write(part)
                    if not d.eof:
                        break
                    rest = d.unused_data
                lines = out.getvalue().split(b"\n")[:-1]
                yield pd.DataFrame({"file": name, "line_no": range(1, len(lines) + 1), "line": [x.decode("utf-8", "replace") for x in lines]})

    return files.mapInPandas(run, "file string, line_no long, line string")


def backfill(spark: SparkSession, root: str, parser, source: str) -> DataFrame:
    """Per source: sessions, candidates, excluded lines and versions under a folder, however deep the files lie."""
    lines = spark.read.option("recursiveFileLookup", True).text(root).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    r = F.col("record")
    return parser(lines).groupBy(F.lit(source).alias("source")).agg(
        F.count_distinct(r["source_session_id"]).alias("sessions"), F.count_if(r["kind"] == "message").alias("candidates"), F.count_if(r["kind"] != "message").alias("excluded"), F.array_sort(F.collect_set(r["transcript_version"])).alias("versions")
    )
