"""Registered queries over the driver tables, each beside its SQL twin."""

from workload import (  # noqa: F401
    evidence_checks, field_checks, image_checks, record_figures, registry_checks, rule_checks,
    stream_checks,
)
from workload.registry import ORACLES, QUERIES  # noqa: F401
