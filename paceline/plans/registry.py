"""Every query of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from paceline.plans import base, extras, forecasts, periods, profiles, reports, sporting, tracks, training, types, yearly  # noqa: F401  (each registers its queries)

QUERIES = base.QUERIES
ORACLES = base.ORACLES
