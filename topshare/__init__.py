"""Concentration and data-quality analytics as Spark DataFrame jobs."""

from topshare.operators.concentration import Concentration, concentrate
from topshare.operators.normalize import Normalized, normalize, plan_normalization
from topshare.operators.profile import negative_policy, profile
from topshare.operators.timekey import TimeSpec, detect_time, with_period_key
from topshare.session import build_session, release_session

__all__ = [
    "Concentration",
    "Normalized",
    "TimeSpec",
    "build_session",
    "concentrate",
    "detect_time",
    "negative_policy",
    "normalize",
    "plan_normalization",
    "profile",
    "release_session",
    "with_period_key",
]
