"""Thresholds shared by every operator. All times come in as ``as_of``, never from a clock."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # fees
    tax_rate: float = 0.06625
    premium_rate: float = 0.15
    pickup: float = 0.0
    # valuation
    target_margin: float = 0.40
    labor_rate: float = 25.0
    min_profit: float = 20.0
    low_bump: float = 0.15
    med_bump: float = 0.07
    default_channel: str = "ebay"
    max_repair_cost: float | None = None
    retail_fallback: float = 0.35
    # exposure
    max_total_exposure: float = 1500.0
    max_open_lots: int = 25
    max_category_exposure: float = 500.0
    overlap_minutes: int = 30
    # comps
    max_age_days: int = 120
    half_life_days: float = 45.0
    min_similarity: float = 0.45
    trim_fraction: float = 0.1
    min_sample: int = 3
    comps_limit: int | None = None  # comps a lookup gives an item, all by default
    # market
    fresh_days: int = 21
    min_rating: float = 4.0
    min_reviews: int = 25
    results_per_search: int | None = None  # usable cards kept per page, all by default
    lookup_sites: tuple[str, ...] = ("amazon", "walmart", "facebook")
    lookup_enabled: bool = True
    searches_per_day: int = 120
    block_cooldown_minutes: int = 360
    # jobs and alerts
    notify_min_profit: float = 25.0
    closing_soon_minutes: int = 90
    stale_minutes: int = 15
    grace_minutes: int = 20
    # execution: groups above this many rows are split before ordering
    heavy_rows: int = 2_000_000
    # execution: an item with up to this many comps is valued inside its row
    packed_points: int = 4096
    # execution: a side is broadcast only when a bounded count stays under this
    broadcast_rows: int = 20_000

    def __post_init__(self) -> None:
        for name in ("tax_rate", "premium_rate", "target_margin"):
            rate = getattr(self, name)
            if not 0.0 <= rate < 1.0:
                raise ValueError(f"{name} must be in [0, 1), got {rate}")

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)
