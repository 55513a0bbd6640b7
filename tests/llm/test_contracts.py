"""The registered queries: names, columns, types and rows, and the SQL twins where there are some."""

import os

import duckdb
import pytest

from threadlens.llm import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

COLUMNS = {
    "op1_hmm_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op2_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op3_chat": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op4_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op5_toxicity": "doc_id bigint, severity double, p_toxic double, toxic boolean",
    "op6_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_mixing": "doc_id bigint, n_tokens bigint, p_good double, p_poor double, p_toxic double, rate double, copies bigint, gap double",
    "op8_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op9_minhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op10_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op11_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op12_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op13_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
}

#: What a query has rows for, other than documents.
ROWS = {"op3_chat": "select count(distinct conv_id) + 1 from conversations", "op13_whitening": "select 8 * count(*) from embeddings"}


def test_all_registered():
    assert set(registry.queries()) == {*COLUMNS, "pipeline"}


@pytest.mark.parametrize("name", COLUMNS)
def test_contract(spark, tmp_path, name):
    df = registry.queries()[name](spark, DATA)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    df.write.parquet(f"{tmp_path}/out")
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = f"select * from '{tmp_path}/out/*.parquet'"
    n = con.sql(ROWS.get(name, "select count(*) from documents")).fetchall()
    assert con.sql(f"select count(*) from ({got})").fetchall() == n
    if sql := registry.oracle_sql().get(name):
        columns = ", ".join(sorted(c.split()[0] for c in COLUMNS[name].split(", ")))
        for a, b in ((sql, got), (got, sql)):
            assert con.sql(f"with a as (select {columns} from ({a})), b as (select {columns} from ({b})) select * from (select * from a except all select * from b) limit 3").fetchall() == []
