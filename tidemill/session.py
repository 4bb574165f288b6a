"""A session with the settings that the operators rely on."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

#: UTC event times, plans adapted at run time, and the state store that keyed state needs.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(name: str = "tidemill", master: str | None = None, settings: Mapping[str, str] | None = None) -> SparkSession:
    """Get or make a session; settings go before SETTINGS."""
    builder = SparkSession.builder.appName(name).config(map={**SETTINGS, **(settings or {})})
    return (builder.master(master) if master else builder).getOrCreate()
