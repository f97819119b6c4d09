"""Queries against their SQL on rows at the edges of what they tell apart."""

from __future__ import annotations

import duckdb
import pytest
from compare import differences

from sessionweave.registry import ORACLES, QUERIES


@pytest.fixture
def same(spark, tmp_path):  # noqa: ANN001, ANN201
    def check(query: str, table: str, rows: list[tuple], schema: str) -> str:
        path = f"{tmp_path}/{table}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
        return differences(QUERIES[query](spark, str(tmp_path)), con, ORACLES[query])

    return check


def test_oversized_lines_at_the_limit(same):  # noqa: ANN001
    """A text of 517 characters makes a line of 601."""
    texts = [None, "", *("x" * n for n in (515, 516, 517, 518)), "ñ" * 516, "ñ" * 517, "\U0001f600" * 516, "\U0001f600" * 517, 'a"\\\n\r\t' * 86, 'a"\\\n\r\t' * 86 + "b"]
    assert same("oversized_lines", "documents", list(enumerate(texts)), "doc_id long, text string") == ""


def _said(conv: int, *texts: str | None) -> list[tuple]:
    return [(conv, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]


def test_session_catalog_at_the_cap(same):  # noqa: ANN001
    """Search texts that fill 300 characters but for the blank before the next text."""
    rows = [r for i, n in enumerate((297, 298, 299, 300, 301)) for r in _said(i, "x" * n, "y" * 9, "z")]
    rows += _said(10, "x" * 298, "", "z") + _said(11, "x" * 149, "y" * 149, "z" * 9) + _said(12, "\U0001f600" * 299, "z") + _said(13, "x" * 299)
    assert same("session_catalog", "conversations", rows, "conv_id long, turn long, role string, text string") == ""


def test_session_catalog_without_texts(same):  # noqa: ANN001
    rows = _said(1, None, "b", "c") + _said(2, None, None) + _said(3, "") + _said(4, "x" * 299, None, "z") + _said(5, None, "a") + [(6, None, "user", "late"), (6, 1, "system", "s"), (6, 2, "assistant", "first")]
    assert same("session_catalog", "conversations", rows, "conv_id long, turn long, role string, text string") == ""
