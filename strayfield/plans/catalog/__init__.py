"""All registered queries, one module per operator group."""

from strayfield.plans.catalog import flows, items, metrics, neighbours, outliers, raster, streams, vectors  # noqa: F401
