"""A workflow version is data: what it reads, the labels it knows, how it parses, and the guidelines it applies."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

# Document kinds in display order, field names, limits, labels and guidelines.
DOCUMENTS = {
    "acord": "Application (SYN-125/140)",
    "sov": "Schedule of values",
    "loss_run": "Loss run",
    "endorsement": "Endorsement request",
    "email": "Broker email",
}
SCALARS = ["insuredName", "receivedDate", "requestedEffectiveDate", "statedTiv", "computedTiv", "lossRunTotalIncurred", "lossCount"]
LOCATION_FIELDS = ["address", "city", "state", "zip", "buildingValue", "contentsValue", "biValue", "constructionType", "yearBuilt"]
VALUE_FIELDS = ["buildingValue", "contentsValue", "biValue"]
TEXT_FIELDS = {"insuredName", "receivedDate", "requestedEffectiveDate", "address", "city", "state", "zip", "constructionType"}
REQUIRED_SCALARS = ["insuredName", "receivedDate", "requestedEffectiveDate"]
REQUIRED_LOCATION_FIELDS = ["address", "buildingValue"]
SOFT_SCALARS = ["statedTiv"]
SOFT_LOCATION_FIELDS = ["contentsValue", "biValue", "constructionType", "yearBuilt"]
CONFIDENCE_FLOOR = 0.6
TIV_TOLERANCE = 1000
FUZZY_THRESHOLD = 0.92
BANDS = [(0.0, 0.6), (0.6, 0.8), (0.8, 0.9), (0.9, 1.0001)]
WHATIF_LIMITS = {"tivCeiling": (1e6, 1e9), "lossRatioCeilingPct": (0, 100), "maxMonthsAhead": (1, 36)}
SIMULATED_RATES = {"input_per_1k": 0.003, "output_per_1k": 0.015}
METERED_RATES = {"default": {"input_per_1m": 0.15, "output_per_1m": 0.60}}
AMENDABLE = {"building": "buildingValue", "contents": "contentsValue", "bi": "biValue", "business interruption": "biValue"}
CONSTRUCTION_KEYWORDS = [
    ("fire[-\\s]resistive", "Fire Resistive"),
    ("masonry non[-\\s]combustible", "Masonry Non-Combustible"),
    ("non[-\\s]combustible", "Non-Combustible"),
    ("joisted masonry", "Joisted Masonry"),
    ("masonry", "Joisted Masonry"),
    ("\\bframe\\b", "Frame"),
]
BACKFILL_WINDOW = 400
EARLIEST_YEAR = 1850

NARROW_LABELS = {
    "insuredName": ["Named Insured", "Applicant"],
    "receivedDate": ["Date Received"],
    "effectiveDate": ["Proposed Effective Date"],
    "statedTiv": ["Total Insured Value"],
    "building": ["Building"],
    "contents": ["Contents"],
    "bi": ["BI"],
    "construction": ["Construction"],
    "yearBuilt": ["Year Built"],
}
WIDE_LABELS = {
    "insuredName": ["Named Insured", "Insured Name (DBA)", "Insured Name", "Applicant", "Insured"],
    "receivedDate": ["Date Received", "Received", "Date Rec"],
    "effectiveDate": ["Proposed Effective Date", "Requested Effective Date", "Effective Date"],
    "statedTiv": ["Total Insured Value", "TIV (stated)", "Total Insurable Value", "TIV"],
    "building": ["Building Value", "Bldg Val", "Building", "Bldg"],
    "contents": ["Contents", "Cont"],
    "bi": ["Business Interruption", "BI"],
    "construction": ["Construction Type", "Construction", "Constr"],
    "yearBuilt": ["Year Built", "Yr Built", "Yr Blt", "Built"],
}


class UnknownVersion(KeyError):
    """No version has this id."""


class BadThreshold(ValueError):
    """A what-if threshold that is not known or out of bounds."""


@dataclass(frozen=True)
class Guidelines:
    tivCeiling: float = 50_000_000
    lossRatioCeilingPct: float = 1.5
    maxMonthsAhead: float = 12
    addressMatching: str = "normalized"


@dataclass(frozen=True)
class Profile:
    id: str
    currency: str = "loose"
    documents: tuple[str, ...] = tuple(DOCUMENTS)
    read_amendments: bool = True
    backfill: bool = False
    passes: int = 1
    engine: str = "rules"
    model: str | None = None
    labels: dict[str, list[str]] = field(default_factory=lambda: WIDE_LABELS)


@dataclass(frozen=True)
class Version:
    id: str
    profile: Profile
    guidelines: Guidelines

    def with_guidelines(self, suffix: str = "", **changes: float) -> Version:
        return replace(self, id=self.id + suffix, guidelines=replace(self.guidelines, **changes))

    def fingerprint(self) -> str:
        """sha256 of the profile as JSON with sorted keys."""
        return hashlib.sha256(json.dumps(asdict(self.profile), sort_keys=True).encode()).hexdigest()


VERSIONS = {
    v.id: v
    for v in (
        Version("v1-regex", Profile("v1-regex", "strict", ("acord", "sov", "loss_run"), False, False, 1, labels=NARROW_LABELS), Guidelines(40_000_000, addressMatching="exact")),
        Version("v2-heuristic", Profile("v2-heuristic", backfill=True, passes=2), Guidelines()),
        Version("v2.1-no-backfill", Profile("v2.1-no-backfill"), Guidelines()),
        Version("v3-llm", Profile("v3-llm", engine="llm", model="default"), Guidelines()),
    )
}
DEFAULT_COMPARISON = ("v1-regex", "v2-heuristic")


def version(id: str) -> Version:
    if id not in VERSIONS:
        raise UnknownVersion(f"unknown version {id!r}; known: {', '.join(VERSIONS)}")
    return VERSIONS[id]


def what_if(base: Version, **thresholds: float) -> Version:
    """The version with other thresholds; each must be known, a number and within its bounds."""
    for name, value in thresholds.items():
        low, high = WHATIF_LIMITS.get(name, (1, 0))
        try:
            ok = low <= float(value) <= high
        except (TypeError, ValueError):
            ok = False
        if not ok:
            raise BadThreshold(f"{name}={value!r}")
    return base.with_guidelines("#whatif", **{k: float(v) for k, v in thresholds.items()})
