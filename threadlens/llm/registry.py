"""Queries and SQL twins of the operators in this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from threadlens.llm.bloom_dedup import OP2_SQL, op2_exact_dedup
from threadlens.llm.bpe import op4_bpe
from threadlens.llm.chat import OP3_SQL, op3_chat
from threadlens.llm.hmm import op1_hmm_lm
from threadlens.llm.langid import op6_langid
from threadlens.llm.minhash import op9_minhash
from threadlens.llm.mixing import op7_mixing
from threadlens.llm.quality import op8_quality
from threadlens.llm.runs import op12_runs
from threadlens.llm.sharding import op10_sharding
from threadlens.llm.token_files import op11_token_files
from threadlens.llm.toxicity import op5_toxicity
from threadlens.llm.whitening import op13_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hmm_lm": op1_hmm_lm,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_chat": op3_chat,
        "op4_bpe": op4_bpe,
        "op5_toxicity": op5_toxicity,
        "op6_langid": op6_langid,
        "op7_mixing": op7_mixing,
        "op8_quality": op8_quality,
        "op9_minhash": op9_minhash,
        "op10_sharding": op10_sharding,
        "op11_token_files": op11_token_files,
        "op12_runs": op12_runs,
        "op13_whitening": op13_whitening,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op3_chat": OP3_SQL}
