"""Settings, from Spark's configuration (tidemark.<name>), the environment, or the defaults.

No credentials are read: orders leave as rows, so nothing here talks to an exchange."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import SparkSession


def _setting(default, env: str | None = None, lenient: bool = False):
    """A field read from env (its name in capitals if None); lenient: a bad value gives the default."""
    return field(default=default, metadata={"env": env, "lenient": lenient})


def _parsed(text: str, kind: type):
    if kind is bool:
        return {"true": True, "false": False}[text]
    if "_" in text or text != text.strip():
        raise ValueError(text)
    value = kind(text)
    if kind is int and value < 0:
        raise ValueError(text)
    return value


class _FromEnv:
    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, spark: SparkSession | None = None):
        """Raises ValueError for a value that can't be read, unless its field is lenient."""
        env, got = os.environ if env is None else env, {}
        for f in fields(cls):
            name = f.metadata["env"] or f.name.upper()
            text = spark.conf.get(f"tidemark.{f.name}", None) if spark is not None else None
            text = env.get(name) if text is None else text
            if text is None:
                continue
            try:
                got[f.name] = _parsed(text, type(f.default))
            except (ValueError, KeyError):
                if not f.metadata["lenient"]:
                    raise ValueError(f"{name}: can't read {text!r}") from None
        return cls(**got)


# fixed values: names and defaults of the settings
@dataclass(frozen=True)
class Settings(_FromEnv):
    use_testnet: bool = _setting(False, lenient=True)
    max_portfolio_leverage: float = _setting(3.0)
    max_single_asset_weight: float = _setting(0.30)
    daily_drawdown_limit: float = _setting(0.08)
    target_daily_vol: float = _setting(0.015)
    kelly_fraction: float = _setting(0.3)
    history_days: int = _setting(180)
    signal_interval_secs: int = _setting(300)
    max_signal_age_ms: int = _setting(5_000)
    dkf_sigma_obs: float = _setting(1e-3)
    dkf_sigma_param_walk: float = _setting(1e-5)
    freq_window_bars: int = _setting(64)
    fusion_evidence_decay: float = _setting(0.99)
    fusion_min_weight: float = _setting(0.05)
    backtest_train_bars: int = _setting(500)
    backtest_test_bars: int = _setting(100)
    impact_eta: float = _setting(0.1)
    impact_kappa: float = _setting(0.3)
    max_combo_assets: int = _setting(3)
    max_combo_tc_bps: float = _setting(25.0)
    enumerate_combo_subsets: bool = _setting(True, lenient=True)


# fixed values: names and defaults of the limits
@dataclass(frozen=True)
class RiskLimits(_FromEnv):
    max_gross_exposure: float = _setting(3.0, "RISK_MAX_GROSS_EXPOSURE", True)
    max_net_exposure: float = _setting(1.5, "RISK_MAX_NET_EXPOSURE", True)
    max_leverage: float = _setting(5.0, "RISK_MAX_LEVERAGE", True)
    max_single_asset_weight: float = _setting(0.30, "RISK_MAX_SINGLE_ASSET_WEIGHT", True)
    max_daily_drawdown: float = _setting(0.08, "RISK_MAX_DAILY_DRAWDOWN", True)
    max_portfolio_drawdown: float = _setting(0.20, "RISK_MAX_PORTFOLIO_DRAWDOWN", True)
    min_signal_confidence: float = _setting(0.60, "RISK_MIN_CONFIDENCE", True)
    min_risk_reward: float = _setting(1.5, "RISK_MIN_RR", True)
    max_concurrent_positions: int = _setting(5, "RISK_MAX_POSITIONS", True)
    target_daily_vol: float = _setting(0.015, "RISK_TARGET_DAILY_VOL", True)
    vol_kill_multiplier: float = _setting(3.0, "RISK_VOL_KILL_MULTIPLIER", True)
    min_log_predictive: float = _setting(-10.0, "RISK_MIN_LOG_PREDICTIVE", True)
    max_pairwise_correlation: float = _setting(0.75, "RISK_MAX_PAIR_CORR", True)
    kelly_fraction: float = _setting(0.3, "RISK_KELLY_FRACTION", True)
