"""How the input views are written: pieces grow with the rows, and no text is sent around only to be dealt out."""

import os

import pytest
from conftest import plan

import workforce_signals as ws
from driver_queries import fixtures as fx
from driver_queries import queries

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


@pytest.mark.parametrize("name", ["fx_sample", "fx_postings"])
def test_joined_views_stay_in_the_pieces_of_their_join(spark, name):
    assert "RoundRobinPartitioning" not in plan(fx._view(spark, SF_DIR, name))


@pytest.mark.parametrize("name", ["fx_profile", "fx_description", "fx_link"])
def test_only_small_tables_are_dealt_out(spark, monkeypatch, name):
    assert "RoundRobinPartitioning" in plan(fx._view(spark, SF_DIR, name))
    monkeypatch.setattr(fx, "_SMALL_BYTES", 0)
    assert "Exchange" not in plan(fx._view(spark, SF_DIR, name))


def test_sample_csv_is_written_from_the_view_in_small_gzip_files(spark, monkeypatch):
    monkeypatch.setattr(fx, "ROWS_PER_CSV", 500)
    monkeypatch.setattr(fx, "_built", {})
    files = ws.list_files(spark, fx.sample_csv(spark, SF_DIR))
    assert all(f.endswith(".csv.gz") for f in files)
    assert [name for _, _, name in fx._built] == ["sample"]  # no second copy of the texts as a stored table
    per_file = [ws.read_profiles_csv(spark, f).count() for f in files]
    assert max(per_file) <= 500 and sum(per_file) == fx.profiles(spark, SF_DIR).count()


@pytest.mark.parametrize("query", [queries.q_merge_profiles, queries.q_parse_spells, queries.q_expand_years, queries.q_parse_spells_current])
def test_texts_are_merged_without_a_stored_copy_and_sent_around_once(spark, monkeypatch, query):
    monkeypatch.setattr(fx, "_built", {})
    found = plan(query(spark, SF_DIR))
    assert not fx._built
    assert "RoundRobinPartitioning" not in found and found.count("Exchange") <= 2


@pytest.mark.parametrize("query", [queries.q_first_hit, queries.q_company_year_share])
def test_searched_texts_have_no_stored_copy(spark, monkeypatch, query):
    monkeypatch.setattr(fx, "_built", {})
    query(spark, SF_DIR)
    assert [name for _, _, name in fx._built] == ["fx_postings"]


def test_a_stored_copy_is_read_where_there_is_one(spark, monkeypatch):
    monkeypatch.setattr(fx, "_built", {})
    viewed = fx.profiles(spark, SF_DIR)
    stored = fx.stored(spark, SF_DIR, "fx_profile")
    assert "orders" not in plan(fx.profiles(spark, SF_DIR))
    assert viewed.dtypes == stored.dtypes
    assert viewed.exceptAll(stored).isEmpty() and stored.exceptAll(viewed).isEmpty()
