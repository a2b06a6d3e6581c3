"""Names of the columns that locate a value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dims:
    """Coordinates of the long tables: a cube is a table with one row for each tuple."""

    time: str = "time"
    lat: str = "lat"
    lon: str = "lon"
    ensemble: str = "ensemble"
    init_date: str = "init_date"
    lead_time: str = "lead_time"

    @property
    def sample(self) -> tuple[str, str, str]:
        """What pooling all model realisations drops."""
        return self.ensemble, self.init_date, self.lead_time


DIMS = Dims()
