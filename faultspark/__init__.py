"""Spark-native analytics for multichannel disturbance records."""

from faultspark.config import SignalConfig

__all__ = ["SignalConfig"]
