"""One table per experiment: every treatment arm with plain, adjusted, sequential and weighted results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemetric.operators import inference as I


def analysis_report(obs: DataFrame, keys: list[str], tau_sq: float = 0.5, alpha: float = 0.05, control: str = "control", delta: Column | None = None, expected: dict[str, float] | None = None, grow_order: list[str] | None = None, grow_sigma_sq: float = 1.0) -> DataFrame:
    """Welch, covariate-adjusted, anytime-valid, mixture-sequential and e-value results from one shared moments pass.

    Inverse-probability weighting is added where the observations have ``p``, cluster-robust
    errors and the sample-ratio check (``expected`` shares, else equal) where they have
    ``user_id``, heterogeneity over segments where they have ``lifecycle_segment``, and the
    equivalence test where its bound ``delta`` is given. With ``grow_order`` (columns that fix
    the order of rows) comes the growth-rate e-value of an arm's values over the control mean.
    """
    pairs = I.arm_pairs(I.moments(obs, keys, covariate=True), keys, control)
    on = [*keys, "variant_id"]
    plain = I.with_t_test(I.msprt(pairs, tau_sq, alpha), alpha).select(*on, "effect", "se", "df", "p_value", "ci_lower", "ci_upper", "always_valid_p", F.col("n_t").alias("n_treatment"), F.col("n_c").alias("n_control"))
    lm = I.avlm(pairs, tau_sq, alpha).select(*on, F.col("effect").alias("adjusted_effect"), F.col("se").alias("adjusted_se"), "variance_reduction", F.col("half_width").alias("anytime_half_width"))
    out = plain.join(lm, on).join(I.e_value_adjusted(pairs, tau_sq, alpha).select(*on, "log_e"), on)
    if delta is not None:
        out = out.join(I.with_tost_p(I.tost(I.welch(pairs), delta), alpha).select(*on, F.col("p_value").alias("tost_p"), "equivalent"), on)
    if "p" in obs.columns:
        out = out.join(I.ipw(obs, keys, control=control).select(*on, F.col("effect").alias("ipw_effect"), F.col("se").alias("ipw_se"), "ess"), on, "left")
    if "user_id" in obs.columns:
        out = out.join(I.clustered(obs, keys, "user_id", control).select(*on, F.col("se").alias("clustered_se"), "design_effect"), on, "left")
        srm = I.with_srm_p(I.srm_check(obs, keys, expected)).select(*keys, F.col("p_value").alias("srm_p"), F.col("mismatch").alias("srm_mismatch"))
        out = out.join(F.broadcast(srm), keys, "left")  # a row a key
    if "lifecycle_segment" in obs.columns:
        cut = [*keys, "lifecycle_segment"]
        segments = I.welch(I.arm_pairs(I.moments(obs.filter("lifecycle_segment is not null"), cut), cut, control))
        out = out.join(I.cochran_q(segments, on).select(*on, F.col("k").alias("segments"), "q", F.col("p_value").alias("q_p"), "i_squared"), on, "left")
    if grow_order:
        base = pairs.select(*on, "mean_c")  # a row a key and arm
        above = obs.select(*on, *grow_order, "y").join(F.broadcast(base), on).withColumn("y", F.col("y") - F.col("mean_c"))
        grown = I.e_value_grow(above, on, grow_order, grow_sigma_sq, alpha)
        out = out.join(grown.select(*on, F.col("log_e").alias("grow_log_e"), F.col("reject").alias("grow_reject")), on, "left")
    return out
