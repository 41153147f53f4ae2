"""Decision rules from totals and intervals to a label: pure functions of scalars, for results that are one row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np


def headroom(ci_low: float, smallest_effect: float = 0.10) -> str:
    """How far above the floor an interval lies, in smallest effects of interest: two of them, one, or less."""
    if ci_low >= 2 * smallest_effect:
        return "ADEQUATE_HEADROOM"
    return "MARGINAL_HEADROOM" if ci_low >= smallest_effect else "FLOOR_LIMITED"


def signal_present(point: float, ci_low: float, least_point: float, least_low: float) -> bool:
    return point >= least_point and ci_low > least_low


def interaction(omnibus_p: float, estimates: Mapping[str, float], adjusted_p: Mapping[str, float], family: Sequence[str] | None = None, smallest_effect: float = 0.10, alpha: float = 0.05) -> str:
    """Label of a family of difference-in-differences behind one omnibus test.

    Without omnibus evidence nothing is claimed; else sizes come before adjusted p-values: one large enough must be there, and
    one of the large ones must hold after adjustment. A family other than the registered one, values that are not finite and
    p-values outside 0 to 1 are refused.
    """
    names = set(estimates if family is None else family)
    if not names or set(estimates) != names or set(adjusted_p) != names:
        raise ValueError(f"estimates and p-values must be of exactly {sorted(names)}")
    p_values = np.array([omnibus_p, *adjusted_p.values()], float)
    if not np.isfinite([*p_values, *estimates.values()]).all() or (p_values < 0).any() or (p_values > 1).any():
        raise ValueError("estimates must be finite and p-values from 0 to 1")
    large = [name for name, e in estimates.items() if abs(e) >= smallest_effect]
    if omnibus_p > alpha:
        return "NO_CONFIRMATORY_MODEL_BUDGET_INTERACTION_EVIDENCE"
    if not large:
        return "INTERACTION_DETECTED_BELOW_PLANNED_SESOI"
    held = min(adjusted_p[name] for name in large) <= alpha
    return "MEANINGFUL_MODEL_BUDGET_INTERACTION_SUPPORTED" if held else "SUGGESTIVE_MEANINGFUL_INTERACTION_NOT_CONFIRMED"


def primary_cause(flags: Mapping[str, bool]) -> str:
    """The first cause in order of priority that holds."""
    for cause in ("format_loss", "loop", "omission", "overgeneration", "reading_order"):
        if flags.get(cause):
            return cause
    return "misread"


def best_of(lower_bounds: Mapping[str, Mapping[str, float]]) -> str | None:
    """The model whose difference from every other one has a lower bound above 0, or None."""
    return next((m for m, others in sorted(lower_bounds.items()) if others and all(v > 0 for v in others.values())), None)


def gate(auroc: float | None, recall: float | None, least_auroc: float = 0.75, least_recall: float = 0.40) -> str:
    if auroc is None or recall is None:
        return "NOT_ESTIMABLE"
    return "PASS" if auroc >= least_auroc and recall >= least_recall else "FAIL"


def chi_square_tail(x: float, df: int) -> float:
    """P(chi-square >= x) for a few degrees of freedom, by the closed recurrences from 1 and 2."""
    from math import erfc, exp, gamma, sqrt

    if x <= 0:
        return 1.0
    tail, k = (erfc(sqrt(x / 2)), 1) if df % 2 else (exp(-x / 2), 2)
    while k < df:
        tail += (x / 2) ** (k / 2) * exp(-x / 2) / gamma(k / 2 + 1)
        k += 2
    return tail


def wald(estimates: Sequence[float], draws: np.ndarray) -> dict[str, float | str | None]:
    """Global test of all estimates by the covariance of their bootstrap draws; a singular covariance is said so, not forced."""
    x, cov = np.asarray(estimates, float), np.atleast_2d(np.cov(np.asarray(draws, float), rowvar=False))
    if np.linalg.matrix_rank(cov) < len(x):
        return {"status": "SINGULAR_COVARIANCE", "statistic": None, "p": None}
    value = float(x @ np.linalg.solve(cov, x))
    return {"status": "OK", "statistic": value, "p": chi_square_tail(value, len(x))}


def wald_of(estimates: Sequence[float], covariance: Sequence[Sequence[float]]) -> tuple[str, float | None, float | None]:
    """Status, statistic and p of a global test of all estimates under a covariance; a singular or infinite one is said so, not forced."""
    x, cov = np.asarray(estimates, float), np.asarray(covariance, float)
    if not np.isfinite(cov).all() or np.linalg.matrix_rank(cov) < len(x):
        return "FALLBACK_GLOBAL_TEST_NOT_ESTIMABLE", None, None
    value = float(x @ np.linalg.solve(cov, x))
    return "ESTIMABLE", value, chi_square_tail(value, len(x))


def mann_whitney_p(rank_sum: float, n: int, m: int, tie_sizes: Sequence[int] = ()) -> float | None:
    """Two-sided normal approximation, with ties and continuity correction, from the rank sum of the first sample."""
    from math import erfc, sqrt

    if not n or not m:
        return None
    u, mean = rank_sum - n * (n + 1) / 2, n * m / 2
    total = n + m
    ties = sum(t**3 - t for t in tie_sizes)
    variance = n * m / 12 * (total + 1 - ties / (total * (total - 1)))
    if variance <= 0:
        return 1.0
    return min(1.0, erfc(max(0.0, abs(u - mean) - 0.5) / sqrt(variance) / sqrt(2)))


def logit_shift(rates: Sequence[float], target: float) -> float:
    """The shift of all log odds at which the mean rate is the target."""
    logits = np.log(np.clip(rates, 1e-9, 1 - 1e-9) / (1 - np.clip(rates, 1e-9, 1 - 1e-9)))
    low, high = -30.0, 30.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (1 / (1 + np.exp(-(logits + mid)))).mean() < target else (low, mid)
    return (low + high) / 2


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials, by logarithms; exact at p of 0 and 1."""
    from math import exp, fsum, lgamma, log, log1p

    if k >= n or p <= 0:
        return float(k >= 0)
    if k < 0 or p >= 1:
        return 0.0
    return min(1.0, fsum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * log(p) + (n - j) * log1p(-p)) for j in range(k + 1)))


# The bounds of the readings below.
CONTROL_FLOOR, MATERIAL, GAIN, RECOVERED, RECOVERY_GAIN, LEAST_OMITTED = 0.80, 0.05, 0.10, 0.5, 0.15, 10
LEAST_ACCURACY, MOST_FAILURES = 0.20, 0.01
FITTED, MISFIT, NOT_FITTED = "FIT_SUCCESS_DIAGNOSTICS_PASS", "FIT_SUCCESS_DIAGNOSTICS_FAIL", "FIT_EXCEPTION_NUMERICAL_FALLBACK_ELIGIBLE"
APPROVED, STAGES = "NUMERICAL_GLMM_FIT_EXCEPTION_FALLBACK_AMENDMENT_APPROVED", ("FULL_MODEL_FIT", "NULL_MODEL_FIT")

Interval = Mapping[str, float]  # estimate, ci_low, ci_high


def material(effect: Interval, least: float = MATERIAL) -> bool:
    """Above 0 by its interval, and large enough."""
    return effect["ci_low"] > 0 and effect["estimate"] >= least


def root_cause(following: Interval, accuracy: Interval, retrieval: Interval, rescue: Interval, interface_low: float, signal: tuple[float, float], gain: tuple[float, float]) -> str:
    """Whether failures lie in the interface, in what is seen, in both, or can't be told. signal and gain: least estimate, and what ci_low exceeds."""
    interface = following["ci_low"] >= interface_low
    seen, found, rescued = (signal_present(x["estimate"], x["ci_low"], *least) for x, least in ((accuracy, signal), (retrieval, signal), (rescue, gain)))
    table = {
        "mixed": interface and not seen and rescued,
        "measurement/interface": interface and (seen or found),
        "visual representation": rescued and not (interface or seen or found),
    }
    return next((name for name, holds in table.items() if holds), "inconclusive")


def full_validity(accuracy_low: Mapping[str, float], failure_rate: Mapping[str, float], engineering: bool) -> str:
    """PASS when every model reads enough, hardly any output breaks its contract and the calls are as planned."""
    enough = all(low >= LEAST_ACCURACY for low in accuracy_low.values())
    return "PASS" if enough and engineering and all(rate <= MOST_FAILURES for rate in failure_rate.values()) else "FAIL"


def uses_fallback(fit: Mapping[str, object]) -> bool:
    """Whether a fitted mixed model gives way to the fallback; a report that contradicts itself is refused."""
    status, had, passed = fit.get("fit_status"), fit.get("diagnostics_available"), fit.get("diagnostics_pass")
    consistent = {
        FITTED: had is True and passed is True,
        MISFIT: had is True and passed is False,
        NOT_FITTED: had is False and "diagnostics_pass" not in fit and fit.get("fallback_eligibility") == APPROVED and fit.get("fit_stage") in STAGES,
    }
    if not consistent.get(status, False):
        raise ValueError(f"the report of a fit with status {status!r} contradicts itself or is not eligible")
    return status != FITTED


def zoom_reading(text_share: float | None, figure_share: float | None, gain: float | None) -> str:
    """What tiles recover of absent marks: as text, and more than the whole page under the same prompt; or in figures only."""
    if text_share is not None and text_share >= RECOVERED:
        return "prompt_not_zoom" if gain is None or gain < RECOVERY_GAIN else "resolution_attention_limit"
    return "policy" if figure_share is not None and figure_share >= RECOVERED else "beyond_typhoon_at_this_resolution"


def views_reading(zoom: float, perturbation: float, control: float) -> str:
    if control < CONTROL_FLOOR:
        return "instrument_fails_control"
    if min(zoom, zoom - perturbation) >= GAIN:
        return "zoom_adds_beyond_perturbation"
    return "perturbation_explains_gain" if perturbation >= GAIN else "no_gain_from_views"


def controlled_reading(effect: Interval, control: float, same_stack: bool = True) -> str:
    """Zoom against the same crops without it; what the interval can't tell from 0 is not called an absence."""
    if control < CONTROL_FLOOR or not same_stack:
        return "instrument_fails_control" if control < CONTROL_FLOOR else "stack_differs"
    helps, hurts = effect["estimate"] >= GAIN and effect["ci_low"] > 0, effect["estimate"] <= -GAIN and effect["ci_high"] < 0
    return "zoom_helps" if helps else "zoom_hurts" if hurts else "zoom_not_distinguishable"


def masking_reading(masked: bool, cropped: bool, sized: bool, control: float) -> str:
    """From which of three contrasts are material."""
    if control < CONTROL_FLOOR:
        return "masked_damages_ordinary_reading"
    if masked:
        return "both_contribute" if sized else "competing_content"
    if not cropped:
        return "crop_effect_not_reproduced"
    return "image_size_or_token_count" if sized else "not_distinguishable"


def read_count_reading(effect: Interval, qualified: bool) -> str:
    less = effect["ci_high"] < 0 and effect["estimate"] <= -MATERIAL
    label = "masking_adds_beyond_read_count" if material(effect) else "whole_page_reads_recover_more" if less else "read_count_accounts_for_gain"
    return f"{label}_qualified" if qualified else label


def omission_reading(omitted: int, found_masked: int, found_tight: int) -> str:
    """Why lines are left out of a page: half of them or more are read where other content is masked, or where the crop is tight."""
    if omitted < LEAST_OMITTED:
        return "too_few_omissions"
    return "competing_content" if 2 * found_masked >= omitted else "image_size_or_zoom" if 2 * found_tight >= omitted else "not_readable_alone"


def vote_verdict(fixed: int, broken: int, f1_before: float, f1_after: float) -> str:
    return "PASS" if fixed > broken and f1_after > f1_before else "FAIL"
