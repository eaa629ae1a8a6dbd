"""All registered queries over the driver's tables."""

from undertone.plans import chains, models, relational, settings, signals, spectra, streams  # noqa: F401
from undertone.plans.registry import QUERIES, SQL  # noqa: F401
