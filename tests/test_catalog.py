"""Queries against their SQL on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from lumentext.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = ["substring_freq", "candidate_topk", "viterbi_score", "forward_backward", "record_classify_stats", "missing_ranges", "judge_parse", "judge_consensus", "span_coverage", "span_overlaps", "row_corr", "similarity_cosine", "stream_ingest"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    for p in Path(SF).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    cursor = con.execute(catalog.SQL[name])
    given = [d[0] for d in cursor.description]
    expected = sorted(repr(tuple(r[given.index(c)] for c in columns)) for r in cursor.fetchall())
    assert sorted(given) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == expected


def test_entry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_production_parameters(monkeypatch):
    """What the reference's configuration names: 50,000 candidates, 5 rounds, 512 dimensions."""
    from unittest import mock

    seen = {}
    monkeypatch.setattr(catalog, "_read", mock.MagicMock())
    monkeypatch.setattr(catalog, "_probabilities", mock.MagicMock())
    monkeypatch.setattr(catalog, "_sequences", mock.MagicMock())
    monkeypatch.setattr(catalog, "F", mock.MagicMock())
    monkeypatch.setattr(catalog.vocab, "as_dict", lambda p: {})
    monkeypatch.setattr(catalog.vocab, "induce", lambda docs, **given: seen.update(given) or (None, {}))
    monkeypatch.setattr(catalog.embed, "encode", lambda *a, **given: seen.update(given) or mock.MagicMock())
    catalog.QUERIES["induce_vocab"](None, SF)
    catalog.QUERIES["conv_encode"](None, SF)
    assert seen == {"m": 50_000, "iterations": 5, "width": 512}
