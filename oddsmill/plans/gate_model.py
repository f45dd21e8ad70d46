"""A small gate model as ``model.exported`` gives it: three trees fitted to the training markets of the smaller tables (depth 3, step 0.3,
seed 7), thresholds and votes rounded to six digits. Queries score with it, so that SQL can score the same."""

from __future__ import annotations

MODEL = {
    "levels": {"side": ["NO", "YES"]},
    "weights": [1.0, 0.3, 0.3],
    "trees": [
        [
            "side=NO", 0.5,
            ["market_volume_so_far_usd", 307.53, ["bet_size_rel_to_avg", 0.427036, 0.063813, 0.110821], ["prior_trades_count", 29.5, 0.090909, 0.178226]],
            ["market_volume_so_far_usd", 435.63, ["wallet_age_days", 1081.5, -0.108643, -0.048201], ["prior_trades_count", 47.5, -0.186667, -0.509434]],
        ],
        [
            "market_volume_so_far_usd", 0.025,
            ["wallet_age_days", 79.5, ["implied_prob_at_buy", 0.095, -0.468307, 0.055009], ["bet_size_rel_to_avg", 2.908312, 0.410701, 1.158656]],
            ["avg_bet_size_usd", 17.810542, ["wallet_age_days", 2026.5, 0.014692, -0.057473], ["implied_prob_at_buy", 0.635, -0.04394, -0.248597]],
        ],
        [
            "bet_size_rel_to_avg", 2.240694,
            ["implied_prob_at_buy", 0.455, ["wallet_age_days", 2026.5, 0.036252, -0.096215], ["win_rate", 0.644009, -0.045451, 0.195984]],
            ["prior_trades_count", 5.5, ["avg_bet_size_usd", 10.721083, 0.007333, -0.744277], ["wallet_age_days", 776.5, 0.205044, 0.042467]],
        ],
    ],
}
