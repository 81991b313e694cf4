"""The queries that SQL can express against their SQL."""

from __future__ import annotations

import random

import duckdb
import pandas as pd
import pytest

from skarn.llm import chat, oracle, queries

SF = "/root/testdata/sf0.001"


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(tuple, frame.where(frame.notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(want)
    assert rows_of(got) == rows_of(want)


def test_chat_sql_on_control_strings(spark):
    """Control strings and backslashes in texts and names, turns that break the order, nulls, repeated rows."""
    r = random.Random(8)
    bits = ["<", "s", ">", "/", "[", "INST]", "</s>", "<s>", "\\", "\n", "<<SYS>>", "<|role|>", "<|end|>", "é", "<</SYS>>", "<<", "[/INST]", "\U0001f600"]
    roles = ["system", "user", "assistant", "user", "assistant", "user", "a<|text|>\\b", "", None]
    rows = [(i // 4, r.choice([i % 4, None]), r.choice(roles), r.choice([None, "", "".join(r.choices(bits, k=r.randint(1, 9)))])) for i in range(1200)]
    rows += [(900 + i // 2, i % 2, ["user", "assistant"][i % 2], "".join(r.choices(bits, k=5))) for i in range(40)] + rows[:3]
    schema = "conv_id bigint, turn bigint, role string, text string"
    probe = [(-7, i, role, oracle.PROBE_TEXT) for i, role in enumerate(["user", "assistant"])]
    got = chat.digests(chat.format_conversations(spark.createDataFrame(rows + probe, schema))).toPandas()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.execute(oracle.chat_sql()).df()
    assert set(want.valid) == {True, False} and want.broken_at.nunique() > 3
    assert rows_of(got) == rows_of(want)
