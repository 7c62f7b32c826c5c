"""Composite plans: prepared datasets, dashboard views, the preparation job, registered queries."""
