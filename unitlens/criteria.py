"""Parameters of a pass, as plain dataclasses. Checked before any plan is built."""

from __future__ import annotations

from dataclasses import dataclass, field

from unitlens import fixed_values as fv


class CriteriaError(ValueError):
    pass


@dataclass(frozen=True)
class BuildingCriteria:
    min_year_built: int = 2005
    allow_older_if_renovated: bool = True
    renovation_keywords: tuple = fv.DEFAULT_RENOVATION_KEYWORDS
    min_amenity_matches: int = 3
    amenities: dict = field(default_factory=lambda: dict(fv.DEFAULT_AMENITIES))
    required_amenities: tuple = fv.DEFAULT_REQUIRED_AMENITIES
    require_amenity_evidence: bool = False


@dataclass(frozen=True)
class SearchCriteria:
    cities: tuple = fv.DEFAULT_CITIES
    state: str = fv.DEFAULT_STATE
    zip_codes: tuple = fv.DEFAULT_ZIP_CODES
    enforce_city_whitelist: bool = True
    max_miles: float = 0.6
    require_coordinates: bool = False
    property_types: tuple = fv.DEFAULT_PROPERTY_TYPES
    min_beds: float = 2
    min_baths: float = 2
    min_sqft: int = 1200
    require_known_sqft: bool = False
    min_price: int = 5000
    max_price: int = 12000
    min_lease_months: int = 6
    max_lease_months: int = 12
    require_explicit_lease_term: bool = False
    excluded_keywords: tuple = fv.DEFAULT_EXCLUDED_KEYWORDS
    positive_keywords: tuple = fv.DEFAULT_POSITIVE_KEYWORDS
    building: BuildingCriteria = field(default_factory=BuildingCriteria)

    def __post_init__(self):
        checks = [
            (self.min_price <= self.max_price, "min_price exceeds max_price"),
            (self.min_lease_months <= self.max_lease_months, "min_lease_months exceeds max_lease_months"),
            (min(self.min_sqft, self.min_beds, self.min_baths) >= 0, "size limits must not be negative"),
            (bool(self.cities or self.zip_codes), "name at least one city or ZIP code"),
            (self.max_miles > 0, "max_miles must be positive"),
        ]
        unknown = sorted(set(self.building.required_amenities) - set(self.building.amenities))
        checks.append((not unknown, f"required amenities without phrases: {unknown}"))
        problems = [message for ok, message in checks if not ok]
        if problems:
            raise CriteriaError("; ".join(problems))


@dataclass(frozen=True)
class EnrichmentCriteria:
    only_matched: bool = True
    register: bool = True
    rent_providers: tuple = ("rentcast", "housecanary")
    overpriced_ratio: float = 1.15
    underpriced_ratio: float = 0.90


@dataclass(frozen=True)
class AlertCriteria:
    drop_min_dollars: int = 100
    drop_min_pct: float = 0.02
    max_alerts: int = 25
    cooldown_hours: int = 24
    include_warned: bool = True


@dataclass(frozen=True)
class FallbackCriteria:
    min_results: int = 5
    error_ratio: float = 0.5
    always: bool = False
