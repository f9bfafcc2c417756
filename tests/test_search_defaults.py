"""The comparing queries run the operators' own amount of work."""

import pytest

from tablewright.operators import models
from tablewright.queries import QUERIES


@pytest.mark.parametrize("name", ["compare_classifiers", "compare_regressors", "strategy_search"])
def test_comparing_queries_keep_the_defaults(spark, monkeypatch, name):
    seen = []
    monkeypatch.setattr(models, name, lambda *args, **parameters: seen.append(parameters))
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == [{}]
