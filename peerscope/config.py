"""Thresholds of the analyses. Defaults are those for real claims files; the bindings of the test tables scale them down."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal


@dataclass(frozen=True)
class ScanConfig:
    """Provider-service scan."""

    to_year: int
    minimum_panel: int = 100
    minimum_tested: int = 20
    minimum_descriptive: int = 11
    minimum_peers: int = 100
    tail: float = 0.975
    full: float = 0.99
    z: float = 3.5
    ratio: float = 2.0
    difference: float = 0.10
    comparable_years: int = 3
    tail_years: int = 2
    full_years: int = 1
    panel_edges: tuple[int, ...] = (100, 200, 500, 1000)

    def __post_init__(self):
        if not 0 < self.tail <= self.full <= 1:
            raise ValueError(f"percentile thresholds must be ordered within 0 and 1, found {self.tail} and {self.full}")
        if self.minimum_descriptive > self.minimum_tested:
            raise ValueError("the descriptive minimum exceeds the tested minimum")


@dataclass(frozen=True)
class ScreenConfig:
    """Supplier summary screen."""

    years: tuple[int, ...]
    minimum_panel: int = 100
    minimum_peers: int = 100
    minimum_payment: float = 1_000_000.0
    minimum_exposure: float = 500_000.0
    tail: float = 0.95
    full: float = 0.99
    z: float = 3.5
    ratio: float = 2.0
    dominance: float = 0.80
    band_edges: tuple[int, ...] = (100, 250, 500, 1000, 5000)

    @property
    def latest_year(self) -> int:
        return max(self.years)

    def __post_init__(self):
        if not self.years or not 0 < self.tail <= self.full <= 1:
            raise ValueError("a screen needs years and ordered percentile thresholds")


@dataclass(frozen=True)
class DiscoveryConfig:
    """Selection of service codes from candidates' visible portfolios."""

    coverage_floor: Decimal = Decimal("0.8")
    cumulative_share: Decimal = Decimal("0.8")
    top_codes: int = 3
    cohort_payment: Decimal = Decimal(1_000_000)
    selected_cap: int = 100

    def __post_init__(self):
        if not (0 < self.coverage_floor <= 1 and 0 < self.cumulative_share <= 1 and self.top_codes > 0 and self.cohort_payment > 0 and self.selected_cap > 0):
            raise ValueError("discovery needs shares within 0 and 1 and positive bounds")


@dataclass(frozen=True)
class ReviewConfig:
    """Exact-cell peer review of a candidate cohort, over the stated codes or all."""

    focus_year: int
    state: str = "FL"
    codes: tuple[str, ...] = ()
    minimum_peers: int = 100
    minimum_payment: float = 100_000.0
    minimum_exposure: float = 50_000.0
    tail: float = 0.95
    full: float = 0.99
    z: float = 3.5
    ratio: float = 2.0


#: Scaled to the test tables, so that every flag has both outcomes.
TEST_SCAN = ScanConfig(to_year=2001, minimum_panel=10, minimum_tested=5, minimum_descriptive=2, minimum_peers=12, tail=0.85, full=0.9, z=2.0, ratio=1.3, difference=0.01, panel_edges=(10, 5000, 10000, 20000))
TEST_SCREEN = ScreenConfig(years=(1999, 2000, 2001), minimum_panel=20, minimum_peers=3, minimum_payment=200_000.0, minimum_exposure=1_000.0, tail=0.40, full=0.50, z=0.1, ratio=1.0, dominance=0.30, band_edges=(20, 75, 90))
TEST_DISCOVERY = DiscoveryConfig(coverage_floor=Decimal("0.5"), cumulative_share=Decimal("0.5"), top_codes=2, cohort_payment=Decimal(16_000_000), selected_cap=100)
TEST_REVIEW = ReviewConfig(focus_year=2000, state="NATION_3", codes=("ECONOMY", "LARGE", "MEDIUM", "SMALL", "STANDARD"), minimum_peers=30, minimum_payment=1_000.0, minimum_exposure=100.0, tail=0.80, full=0.90, z=1.0, ratio=1.1)
