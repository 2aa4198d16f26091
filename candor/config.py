"""Metros, and the predicate that selects a metro's businesses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metro:
    key: str
    name: str
    states: tuple[str, ...]
    cities: tuple[str, ...] = ()

    def predicate(self) -> Column:
        inside = F.col("state").isin(*self.states)
        return inside & F.col("city").isin(*self.cities) if self.cities else inside


# The metros of the dataset.
METROS = {
    m.key: m
    for m in (
        Metro("philadelphia", "Philadelphia", ("PA", "NJ", "DE")),
        Metro("santa_barbara", "Santa Barbara", ("CA",), ("Santa Barbara", "Goleta", "Carpinteria", "Montecito", "Isla Vista", "Summerland")),
        Metro("new_orleans", "New Orleans", ("LA",)),
        Metro("tampa", "Tampa", ("FL",)),
        Metro("tucson", "Tucson", ("AZ",)),
        Metro("indianapolis", "Indianapolis", ("IN",)),
        Metro("nashville", "Nashville", ("TN",)),
        Metro("reno", "Reno", ("NV",)),
        Metro("saint_louis", "Saint Louis", ("MO",)),
        Metro("boise", "Boise", ("ID",)),
    )
}
DEFAULT_METRO = "philadelphia"


class UnknownMetro(KeyError):
    pass


def get_metro(key: str) -> Metro:
    if key not in METROS:
        raise UnknownMetro(f"no metro {key!r}; there are {', '.join(sorted(METROS))}")
    return METROS[key]
