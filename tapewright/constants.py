"""Fixed parameters of the analytics, in sessions (rows) unless named otherwise."""

WEEK, MONTH, QUARTER, HALF, YEAR = 5, 21, 63, 126, 252
CHANGES = {"1d": 1, "1w": 5, "1m": 21, "3m": 63, "6m": 126, "1y": 252}

LAMBDA = 0.94
SEED_OBS = 60
REGIME_WINDOW = 252
QUIET, TURBULENT = 0.33, 0.67
CASH_LIKE = 0.03
COVERAGE = 0.80
GAUSSIAN_80 = 1.2816
MIN_TRAIN, MIN_RATIOS = 120, 30

MIN_COMPANIES, MIN_POPULATION, MIN_SECTOR_MEMBERS, MIN_SECTOR_PEERS = 5, 100, 15, 4
MIN_DECILE = 20
BEAR_LOOKBACK, STRESS, CORRECTION = 504, -0.15, -0.05
MIN_BUCKET = 25
CLOSE_HOUR = 16
COOLDOWN, SHOCK, EARNINGS_PAD, BETA_WINDOW = 21, 3.0, 2, 252
CLUSTER_SESSIONS, MIN_DOLLARS = 5, 10_000.0
#: Rows after which the cumulative form of a recursion starts anew, so that powers stay finite.
RECURSION_BLOCK = 1000

#: Announcement days of rate decisions, the second day of each meeting. Fixed values of the published calendar.
MEETINGS = (
    "2021-09-22", "2021-11-03", "2021-12-15", "2022-01-26", "2022-03-16", "2022-05-04", "2022-06-15", "2022-07-27", "2022-09-21", "2022-11-02", "2022-12-14",
    "2023-02-01", "2023-03-22", "2023-05-03", "2023-06-14", "2023-07-26", "2023-09-20", "2023-11-01", "2023-12-13",
    "2024-01-31", "2024-03-20", "2024-05-01", "2024-06-12", "2024-07-31", "2024-09-18", "2024-11-07", "2024-12-18",
    "2025-01-29", "2025-03-19", "2025-05-07", "2025-06-18", "2025-07-30", "2025-09-17", "2025-10-29", "2025-12-10",
    "2026-01-28", "2026-03-18", "2026-04-29", "2026-06-17", "2026-07-29", "2026-09-16", "2026-10-28", "2026-12-09",
    "2027-01-27", "2027-03-17", "2027-04-28", "2027-06-09", "2027-07-28", "2027-09-15", "2027-10-27", "2027-12-08",
)

#: Names of macro targets, and of the places that other targets begin with. Fixed values.
TARGETS = {
    "HI_UNEMPLOYMENT": "Hawaii unemployment rate", "US_UNEMPLOYMENT": "US unemployment rate", "HI_VISITORS": "Hawaii visitor arrivals", "HI_ELECTRICITY": "Hawaii electricity price", "HONOLULU_CPI": "Honolulu CPI (all items)",
    "HONOLULU_CPI_RENT": "Honolulu rent CPI", "HONOLULU_ZHVI": "Honolulu home values (Zillow ZHVI)", "HONOLULU_ZORI": "Honolulu asking rents (Zillow ZORI)", "HONOLULU_SF_MEDIAN": "Honolulu single-family median price",
}
PLACES = {"HI_": "Hawaii ", "US_": "US ", "HONOLULU_": "Honolulu "}
