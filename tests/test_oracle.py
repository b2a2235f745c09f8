"""A quick part of the registry against SQL; ``python -m tests.oracle <folder> [prefix…]`` runs all of it."""

import pytest

from riskfabric.plans import load_checks
from tests import oracle

FOLDER = "/root/testdata/sf0.001"
QUICK = ["volume_early_warning", "upsert_keep_columns", "latest_vessels", "history_latest_stories", "text_story_key", "text_country_mention", "source_family", "source_evidence", "hazard_attachment",
         "stratified_articles", "geo_nearest_position", "risk_country_relevance", "risk_article", "country_assessment", "ppmi_prototypes", "eval_threshold_sweep", "forecast_projection",
         "match_event_pairs", "rank_hashed_features", "rank_affinity", "feed_hazards", "feed_rss_articles", "feed_coastal_positions", "stream_volume_windows", "stream_static_merge"]


@pytest.fixture(scope="module")
def database():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, database, name):
    function, sql = load_checks()[name]
    ok, note = oracle.compare(spark, database, FOLDER, name, function, sql)
    assert ok, note


def test_every_query_is_registered_once():
    checks = load_checks()
    assert len(checks) > 140 and sum(1 for _, sql in checks.values() if sql) > 115
