"""Named queries over the driver tables. Importing this package fills the catalog."""

from comarca.plans import (  # noqa: F401
    aggregation,
    designing,
    exposing,
    forecasting,
    indexing,
    ingestion,
    joining,
    quality_checks,
    regression,
    scalars,
    setops,
    streams,
    windowing,
)
from comarca.plans.catalog import CATALOG  # noqa: F401
