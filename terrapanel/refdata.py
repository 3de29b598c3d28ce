"""Fixed values the results depend on."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
# The 48 contiguous states: the grid files' own code, FIPS code, postal abbreviation.
STATES = [
    ("01", "01", "AL"),
    ("02", "04", "AZ"),
    ("03", "05", "AR"),
    ("04", "06", "CA"),
    ("05", "08", "CO"),
    ("06", "09", "CT"),
    ("07", "10", "DE"),
    ("08", "12", "FL"),
    ("09", "13", "GA"),
    ("10", "16", "ID"),
    ("11", "17", "IL"),
    ("12", "18", "IN"),
    ("13", "19", "IA"),
    ("14", "20", "KS"),
    ("15", "21", "KY"),
    ("16", "22", "LA"),
    ("17", "23", "ME"),
    ("18", "24", "MD"),
    ("19", "25", "MA"),
    ("20", "26", "MI"),
    ("21", "27", "MN"),
    ("22", "28", "MS"),
    ("23", "29", "MO"),
    ("24", "30", "MT"),
    ("25", "31", "NE"),
    ("26", "32", "NV"),
    ("27", "33", "NH"),
    ("28", "34", "NJ"),
    ("29", "35", "NM"),
    ("30", "36", "NY"),
    ("31", "37", "NC"),
    ("32", "38", "ND"),
    ("33", "39", "OH"),
    ("34", "40", "OK"),
    ("35", "41", "OR"),
    ("36", "42", "PA"),
    ("37", "44", "RI"),
    ("38", "45", "SC"),
    ("39", "46", "SD"),
    ("40", "47", "TN"),
    ("41", "48", "TX"),
    ("42", "49", "UT"),
    ("43", "50", "VT"),
    ("44", "51", "VA"),
    ("45", "53", "WA"),
    ("46", "54", "WV"),
    ("47", "55", "WI"),
    ("48", "56", "WY"),
]

# Measured variables in merge order, and the panel column each one fills.
MEASURES = {"tmax": "tmax_f", "tmin": "tmin_f", "tavg": "tavg_f", "prcp": "prcp_in"}
# Variables that are summed over the month; the others are averaged.
SUMMED = ("prcp",)

# File status in order of preference.
STATUSES = ("scaled", "prelim")

# A reading at or below this is a missing-data marker.
MISSING_AT_OR_BELOW = -900.0
MM_PER_INCH = 25.4

# Inclusive climate-normal window.
BASELINE_START, BASELINE_END = 1991, 2020

# Old population source: codes kept and the year of code 0.
DATE_CODE_FIRST, DATE_CODE_LAST, DATE_CODE_YEAR_ZERO = 3, 12, 2007
POPULATION_FIRST_YEAR = 2010
OLD_POPULATION_SOURCE = "api_2019_vintage"
STATE_SUMMARY_LEVEL = "040"
ESTIMATE_PREFIX = "POPESTIMATE"

# Overlay datasets: id -> (label, unit, status).
OVERLAYS = {
    "census_population": ("Population", "people", "live"),
    "bls_unemployment": ("Unemployment rate", "%", "planned"),
    "usda_crop_yields": ("Crop yields", None, "planned"),
    "fbi_crime": ("Crime rate", None, "planned"),
    "cdc_mortality": ("Mortality rate", None, "planned"),
}

# ---------------------------------------------------------------------------


def state_rows() -> list[tuple[str, str, str]]:
    """(grid code, FIPS, postal) for every state."""
    return list(STATES)
