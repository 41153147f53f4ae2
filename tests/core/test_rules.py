import math

import numpy as np
import pytest

from tallyloom.plans import rules as R


def test_tails():
    assert abs(R.chi_square_tail(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(R.chi_square_tail(5.991464547107979, 2) - 0.05) < 1e-9
    assert abs(R.chi_square_tail(7.814727903251179, 3) - 0.05) < 1e-9
    assert R.mann_whitney_p(6, 3, 3) < R.mann_whitney_p(10.5, 3, 3) == 1.0
    assert R.wald([1, 1], np.ones((5, 2)))["status"] == "SINGULAR_COVARIANCE"


def test_labels():
    assert [R.headroom(x, 0.1) for x in (0.21, 0.2, 0.19, 0.1, 0.09, -0.1)] == ["ADEQUATE_HEADROOM"] * 2 + ["MARGINAL_HEADROOM"] * 2 + ["FLOOR_LIMITED"] * 2
    label = lambda omnibus, *pairs: R.interaction(omnibus, dict(enumerate(e for e, _ in pairs)), dict(enumerate(p for _, p in pairs)))
    assert label(0.051, (1, 0.01)).startswith("NO_CONFIRMATORY") and label(0.05, (0.09, 0.01)).startswith("INTERACTION_DETECTED_BELOW")
    assert label(0.05, (-0.1, 0.05), (0.01, 0.9)).startswith("MEANINGFUL") and label(0.01, (0.1, 0.06), (0.01, 0.01)).startswith("SUGGESTIVE")
    for bad in (lambda: label(float("nan"), (1, 0.1)), lambda: label(0.1, (1, 1.1)), lambda: R.interaction(0.1, {"a": 1}, {"b": 1}), lambda: R.interaction(0.1, {"a": 1}, {"a": 1}, ["a", "b"])):
        with pytest.raises(ValueError):
            bad()
    assert R.primary_cause({"omission": True, "loop": True}) == "loop" and R.primary_cause({}) == "misread"
    assert R.best_of({"a": {"b": 0.1}, "b": {"a": -0.1}}) == "a" and R.best_of({"a": {"b": 0}, "b": {"a": 0}}) is None
    assert R.gate(None, 1) == "NOT_ESTIMABLE" and R.gate(0.8, 0.5) == "PASS"
    shift = R.logit_shift([0.2, 0.6], 0.5)
    assert abs(np.mean([1 / (1 + math.exp(-(math.log(p / (1 - p)) + shift))) for p in (0.2, 0.6)]) - 0.5) < 1e-9
