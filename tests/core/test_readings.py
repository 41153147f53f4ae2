"""Decision rules at their bounds."""

import pytest

from tallyloom.plans import rules as R


def interval(estimate, low, high=1.0):
    return {"estimate": estimate, "ci_low": low, "ci_high": high}


def test_binomial_cdf():
    from math import comb

    for n in (1, 7, 40):
        for k in range(-1, n + 2):
            for p in (0.0, 0.01, 0.3, 1.0):
                want = sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(min(k, n) + 1))
                assert abs(R.binomial_cdf(k, n, p) - want) < 1e-9


def test_root_cause():
    yes, no = interval(0.8, 0.6), interval(0.5, 0.3)
    label = lambda *four: R.root_cause(*four, 0.6, (0.6, 0.5), (0.2, 0.0))
    assert label(yes, no, no, yes) == label(yes, no, yes, yes) == "mixed"
    assert label(yes, yes, no, yes) == label(yes, no, yes, interval(0.1, 0.1)) == "measurement/interface"
    assert label(no, no, no, yes) == "visual representation" and label(no, yes, no, yes) == label(yes, no, no, interval(0.2, 0.0)) == "inconclusive"


def test_validity_and_routing():
    assert R.full_validity({"a": 0.2, "b": 0.9}, {"a": 0.01, "b": 0}, True) == "PASS"
    assert R.full_validity({"a": 0.19}, {"a": 0}, True) == R.full_validity({"a": 0.2}, {"a": 0.011}, True) == R.full_validity({"a": 0.2}, {"a": 0}, False) == "FAIL"
    had = lambda status, passed: {"fit_status": status, "diagnostics_available": True, "diagnostics_pass": passed}
    failed = {"fit_status": R.NOT_FITTED, "diagnostics_available": False, "fallback_eligibility": R.APPROVED, "fit_stage": "NULL_MODEL_FIT"}
    assert [R.uses_fallback(x) for x in (had(R.FITTED, True), had(R.MISFIT, False), failed)] == [False, True, True]
    for bad in (had(R.FITTED, False), had(R.MISFIT, True), failed | {"diagnostics_pass": None}, failed | {"fit_stage": "X"}, {"fit_status": "OTHER"}, {}):
        with pytest.raises(ValueError):
            R.uses_fallback(bad)


def test_readings():
    assert [R.zoom_reading(*x) for x in ((0.5, 0, 0.15), (0.5, 1, 0.14), (0.5, 1, None), (0.4, 0.5, 1), (None, None, None))] == [
        "resolution_attention_limit", "prompt_not_zoom", "prompt_not_zoom", "policy", "beyond_typhoon_at_this_resolution"]
    assert [R.views_reading(*x) for x in ((1, 0, 0.79), (0.2, 0.05, 0.8), (0.2, 0.15, 0.8), (0.2, 0.125, 0.8), (0.05, 0, 0.8))] == [
        "instrument_fails_control", "zoom_adds_beyond_perturbation", "perturbation_explains_gain", "perturbation_explains_gain", "no_gain_from_views"]
    assert [R.controlled_reading(*x) for x in ((interval(0.1, 0.01), 0.8), (interval(0.1, 0.0), 0.8), (interval(-0.1, -0.3, -0.01), 0.8), (interval(1, 1), 0.7, False), (interval(1, 1), 0.8, False))] == [
        "zoom_helps", "zoom_not_distinguishable", "zoom_hurts", "instrument_fails_control", "stack_differs"]
    t, f = True, False
    assert [R.masking_reading(*x) for x in ((t, t, t, 0.7), (t, f, t, 1), (t, f, f, 1), (f, t, t, 1), (f, f, t, 1), (f, t, f, 1))] == [
        "masked_damages_ordinary_reading", "both_contribute", "competing_content", "image_size_or_token_count", "crop_effect_not_reproduced", "not_distinguishable"]
    assert [R.read_count_reading(*x) for x in ((interval(0.05, 0.01), f), (interval(0.05, 0.0), t), (interval(-0.05, -1, -0.01), t))] == [
        "masking_adds_beyond_read_count", "read_count_accounts_for_gain_qualified", "whole_page_reads_recover_more_qualified"]
    assert [R.omission_reading(*x) for x in ((9, 9, 9), (10, 5, 0), (10, 4, 5), (10, 4, 4))] == ["too_few_omissions", "competing_content", "image_size_or_zoom", "not_readable_alone"]
    assert [R.vote_verdict(*x) for x in ((2, 1, 0.5, 0.6), (1, 1, 0.5, 0.6), (2, 1, 0.5, 0.5))] == ["PASS", "FAIL", "FAIL"]
