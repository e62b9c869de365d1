"""Presence thresholds and the status ladder."""

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# States a heartbeat may claim.
STATES = ("active", "idle", "away")


@dataclass(frozen=True)
class Cadence:
    """Heartbeat interval and thresholds in milliseconds; heartbeat < idle < offline."""

    heartbeat_ms: int = 15_000
    idle_ms: int = 60_000
    offline_ms: int = 180_000
    retention_days: int = 30

    def __post_init__(self):
        if not 0 < self.heartbeat_ms < self.idle_ms < self.offline_ms:
            raise ValueError("need heartbeat_ms < idle_ms < offline_ms")
        if self.retention_days < 1:
            raise ValueError("retention_days must be at least 1")

    @property
    def credit_cap_ms(self) -> int:
        return 2 * self.heartbeat_ms


def age_status(last_seen: Column, claimed: Column, as_of: Column, cadence: Cadence = Cadence()) -> Column:
    """Status from the age of the last heartbeat; the claim only counts while it is fresh."""
    age = F.unix_millis(as_of) - F.unix_millis(last_seen)
    return (
        F.when(age >= cadence.offline_ms, "offline")
        .when(age >= cadence.idle_ms, "idle")
        .otherwise(claimed)
    )
