"""What a judge is asked about a message: the question set, and the input within a byte budget."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.chunking import utf16

#: Fixed: the fields asked of every part, the axes of strategy, and how ids are built.
FIELDS = ("retention", "decision_action", "continuity", "statement_status")
AXES = ("state_hazard", "consistency_strategy", "lifecycle_strategy", "failure_strategy", "performance_strategy", "scope_invariant", "evidence_strategy")
PART = "#0"
PRIOR_MESSAGES = 6


def question_ids(candidates: Column, same_conditions: Column, searchable: Column) -> Column:
    """Ids of the questions, in order: fields, search action of user inputs, relation target, axes, same conditions, each candidate's relation."""
    some = lambda *ids: F.array(*[F.lit(i + PART) for i in ids])
    none = F.array().cast("array<string>")
    return F.concat(
        some(*FIELDS),
        F.when(searchable, some("search_action")).otherwise(none),
        some("relation_target", *[f"strategy:{a}" for a in AXES]),
        F.when(same_conditions, some("same_conditions")).otherwise(none),
        F.transform(candidates, lambda c: F.concat(F.lit("relation_explicit:"), c.cast("string"), F.lit(PART))),
    )


def _questions(part: dict, candidates: list, same_conditions: bool, searchable: bool) -> dict:
    ids = [*FIELDS, *(["search_action"] if searchable else []), "relation_target", *[f"strategy:{a}" for a in AXES], *(["same_conditions"] if same_conditions else []), *[f"relation_explicit:{c}" for c in candidates]]
    where = f"offset {part['offset']}, {part['length']} units"
    return {i + PART: {"type": "choice", "instructions": f"{i} of {where}", "criteria": [*map(str, candidates), "none", "unknown"] if i == "relation_target" else []} for i in ids}


def body_of(target: dict, part: dict, priors: list[dict], search: dict | None, omitted: tuple[int, bool, bool]) -> str:
    """The serialised request; what is sent and what is measured are the same string."""
    state = {
        "current": {**{k: target[k] for k in ("message_id", "revision", "role", "occurred_at")}, "parts": [part]},
        "prior_messages": priors,
        "prior_search": search,
        "truncation": {"omitted_prior_messages": omitted[0], "split_current": omitted[1], "prior_search_omitted": omitted[2]},
    }
    user = target["role"] == "user"
    return json.dumps({"state": state, "questions": _questions(part, [p["message_id"] for p in priors], user and search is not None, user)}, ensure_ascii=False, separators=(",", ":"), default=str)


def _fit(target: dict, part: dict, priors: list[dict], search: dict | None, budget: int, split: bool) -> dict | None:
    """One part with as many whole prior messages as fit, nearest first, then the prior search; None if the part alone is too long."""
    def size(n: int, with_search: bool) -> int:
        return len(body_of(target, part, priors[:n], search if with_search else None, (len(priors) - n, split, search is not None and not with_search)).encode())

    if size(0, False) > budget:
        return None
    n = 0
    while n < len(priors) and size(n + 1, False) <= budget:
        n += 1
    has = search is not None and search.get("input_text") is not None and size(n, True) <= budget
    state = body_of(target, part, priors[:n], search if has else None, (len(priors) - n, split, search is not None and not has))
    return {"offset": part["offset"], "length": part["length"], "priors": [p["message_id"] for p in priors[:n]], "search": has, "bytes": size(n, has), "state_hash": hashlib.sha256(state.encode()).hexdigest()}


def plan_inputs(target: dict, priors: list[dict], search: dict | None, budget: int) -> list[dict]:
    """The requests for one message: whole if it fits, else cut into the longest parts that fit on their own, no character split."""
    text, at = target["text"], utf16(target["text"])
    part = lambda a, b: {"offset": at[a], "length": at[b] - at[a], "text": text[a:b]}
    if (whole := _fit(target, part(0, len(text)), priors, search, budget, False)) is not None:
        return [whole]
    out, start = [], 0
    while start < len(text):
        low, high = start, len(text)
        while low < high:  # the longest part within the budget
            mid = (low + high + 1) // 2
            fits = len(body_of(target, part(start, mid), [], None, (0, True, False)).encode()) <= budget
            low, high = (mid, high) if fits else (low, mid - 1)
        if low == start or (fitted := _fit(target, part(start, low), priors, search, budget, True)) is None:
            return [{"offset": at[start], "length": 0, "priors": [], "search": False, "bytes": 0, "state_hash": "input_budget_exceeded"}]
        out.append(fitted)
        start = low
    return out


def judge_inputs(targets: DataFrame, budget: int) -> DataFrame:
    """(message_id, part, offset, length, priors, prior_search, bytes, state_hash): the judge's requests for every message.

    ``targets``: message_id, revision, role, occurred_at, text, priors (array of message_id, revision, role, occurred_at, text; nearest first, a
    bounded few) and prior_search (struct with input_text, or null). A message whose questions alone exceed the budget gives one row that says so.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                target = {k: r[k] for k in ("message_id", "revision", "role", "occurred_at", "text")}
                search = r["prior_search"] if isinstance(r["prior_search"], dict) else None
                for i, x in enumerate(plan_inputs(target, [dict(p) for p in r["priors"]], search, budget)):
                    rows.append((r["message_id"], i, x["offset"], x["length"], x["priors"], x["search"], x["bytes"], x["state_hash"]))
            yield pd.DataFrame(rows, columns=["message_id", "part", "offset", "length", "priors", "prior_search", "bytes", "state_hash"])

    return targets.mapInPandas(run, "message_id long, part int, offset int, length int, priors array<long>, prior_search boolean, bytes int, state_hash string")
