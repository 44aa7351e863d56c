"""Imports every query module so that the registry is complete."""

from workload import q_augment, q_convert, q_scoring, q_sources, q_validate, q_windows  # noqa: F401
from workload.registry import QUERIES, SQL  # noqa: F401
