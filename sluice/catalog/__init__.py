"""All registered queries; importing the package fills the registry."""

from sluice.catalog import (  # noqa: F401
    aggregates, changes, filters, functions, joins, shaping, sinks, sources, specs, streams, validation,
)
from sluice.catalog.base import ORACLES, QUERIES  # noqa: F401
