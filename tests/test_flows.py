"""Whole flows on the same rows; the prepared tables are checked by SQL with the registered queries."""

import pytest
from pyspark.sql import functions as F

from millrace.plans import flows


def test_match_reports(small):
    got = flows.match_reports(small.v_matches, "pool", ["dt", "match_id"], "dt", min_matches=10, top_n=5)
    top = got["top"].collect()
    assert len(top) == 5 and [r.elo for r in top] == sorted((r.elo for r in top), reverse=True)
    assert got["history"].count() == small.v_matches.count()
    assert got["clean_sheets"].count() == 5 and got["win_rates"].count() == 5
    years = [r.period for r in got["yearly"].orderBy("period").collect()]
    assert years == [r[0] for r in small.v_matches.select(F.year("dt")).distinct().orderBy(F.year("dt")).collect()]


def test_classifier_reports(small):
    got = flows.classifier_reports(small.v_scored, "y", "logits")
    assert got["confusion"].count() == 100
    assert got["report"].filter("name = 'accuracy'").first().support == small.v_scored.count()
    areas = {r.kind: r.auc for r in got["areas"].collect()}
    assert set(areas) == {"macro", "micro"} and all(0 < a < 1 for a in areas.values())
    loss = got["loss"].first()
    assert loss.total == pytest.approx(0.6 * loss.ce + 0.2 * loss.soft_precision + 0.2 * loss.focal)
    assert got["roc"].select("class").distinct().count() == 10 and got["pr"].filter("threshold is null").count() == 10
