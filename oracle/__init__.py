"""Oracle SQL per query. Claim queries are computed from the planted truth, not from the rendered texts."""

from .claims import CLAIM_ORACLES
from .tables import TABLE_ORACLES

ORACLES = {**CLAIM_ORACLES, **TABLE_ORACLES}
