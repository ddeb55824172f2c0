"""One step of online false-discovery control with e-values."""

from __future__ import annotations


def fdr_step(wealth: float, t: int, e_value: float | None, alpha: float, decay: float) -> tuple[float, bool, float]:
    """(level, whether the test is rejected, wealth afterwards) of test ``t``, counted from 0.

    The level is wealth·(1-d)·d^t; a test is rejected at E ≥ 1 / level, and wealth loses the
    level and regains alpha with a rejection. A null e-value is no evidence. Without wealth
    nothing is rejected.
    """
    if wealth < 1e-15:
        return 0.0, False, wealth
    level = wealth * (1 - decay) * decay**t
    hit = level > 0 and e_value is not None and e_value * level >= 1
    return level, hit, max(0.0, wealth - level + (alpha if hit else 0.0))
