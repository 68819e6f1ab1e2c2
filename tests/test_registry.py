import __spark_entry__
import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    def plain(v):
        v = round(v, 6) if isinstance(v, float) else v
        text = str(v)
        return text.removesuffix(" 00:00:00")

    return sorted(tuple(plain(r[c]) for c in sorted(frame.columns)) for _, r in frame.iterrows())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", ["version_diff_units", "diff_emission_order", "signal_agreement", "entry_counts", "changes_since_topn", "best_hit_rank", "trailing_event_count", "markup_strip", "streaming_poll", "table_entry_diff", "location_parse", "three_signal_merge", "dump_order", "deferral_detector"])
def test_matches_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, DATA).toPandas()
    want = duck.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
