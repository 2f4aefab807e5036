import duckdb
import pytest

from quotemill.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "events lineitem orders part documents customer supplier pages".split()


def rows(df):
    return sorted((tuple(None if v != v or v is None else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", ["resample_1h", "split_adjust", "daily_atr", "market_cap", "scan_report", "scan_daily_parabolic_up", "dq_missing_extra", "lookback_days", "symbol_universe", "slice_ranges", "rotating_batch", "expired_partitions", "splits_merge", "earnings_merge", "shares_float", "news_confidence", "headline_mentions", "new_headlines", "score_comparison", "dq_missing_streams", "parse_scores", "fundamentals_parse", "page_headlines", "subscription_counts"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    for c in got.columns:
        if str(want[c].dtype).startswith("datetime"):
            got[c] = got[c].astype(want[c].dtype)
        elif want[c].dtype.kind == "f":
            got[c], want[c] = got[c].astype(float).round(5) + 0.0, want[c].round(5) + 0.0
    assert rows(got) == rows(want)
