"""Queries over whole inputs: all pairs, sequences of any length, all documents."""

import pytest

from strandlake import plans


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("tables"))
    items = [(1, "ACGTACGTACGTAC"), (6, "ACGTACGTACGTAC"), (11, "ACGTACGTACGTAC"), (2, "ACGT" * 25), (7, "ACGT" * 30)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    spark.createDataFrame([(1, "ACGT" * 10, "en", "s", 40)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{to}/documents.parquet")
    return to


def test_dot_plot_covers_all_pairs(spark, folder):
    found = plans.QUERIES["al_8_dot_plot"](spark, folder).select("id_a", "id_b").distinct().collect()
    assert sorted(map(tuple, found)) == [(1, 6), (1, 11), (2, 7), (6, 11)]


def test_consensus_keeps_long_sequences(spark, folder):
    found = {r.grp: r.consensus for r in plans.QUERIES["al_4_consensus"](spark, folder).collect()}
    assert found[2].startswith("ACGT" * 25) and len(found[2]) == 120


def test_complexity_runs_over_documents(spark, folder):
    assert sorted(r.pos for r in plans.QUERIES["wn_4_window_complexity"](spark, folder).collect()) == list(range(21))
