"""Fixed values of the risk model: severities, issues, thresholds, bands, tables. Stated as plain data."""

# severity: ordinal and base travel-time multiplier
SEVERITY = {"INFO": 1.0, "MINOR": 1.15, "MAJOR": 1.6, "SEVERE": 2.75}
# issue weights, in order of specificity
ISSUE = {"TRACK": 1.0, "SIGNAL": 0.95, "VEHICLE": 0.9, "DOOR": 0.8, "ELEVATOR": 0.35, "WEATHER": 0.75, "ROAD": 0.7, "CROWDING": 0.55, "DELAY": 0.6, "UNKNOWN": 0.5}
AVOID, MATERIAL, REPORTABLE, JUNK_QUALITY = 0.7, 0.4, 0.30, 0.5
BANDS = ((0.85, "VERY_HIGH"), (0.65, "HIGH"), (0.4, "MODERATE"), (0.2, "LOW"))
BADGES = ((0.9, "A"), (0.75, "B"), (0.55, "C"), (0.35, "D"))
# social strength by number of distinct authors (six or more: the last)
SOCIAL = (0.0, 0.22, 0.32, 0.45, 0.53, 0.58, 0.60)
OFFICIAL, REALTIME_EACH, REALTIME_CAP = 0.9, 0.05, 0.15
UNRESOLVED, UNRESOLVED_CAP, DENIAL, OFFLINE = 0.8, 0.45, 0.25, 0.85
STALE_FLOOR, WINDOW_MINUTES = 0.15, 90
# confidence -> weight knots, linear between
KNOTS = ((0.0, 0.0), (0.4, 0.4), (0.7, 0.8), (1.0, 1.35))
WALK_BASE, WALK_SPEED, WALK_CAP, WALK_LIMIT = 120, 1.2, 900, 350
Z90, SPREAD, JITTER, JITTER_ROOT = 1.2816, 0.5, 25.0, 10.0
EARTH_M = 6371008.8
