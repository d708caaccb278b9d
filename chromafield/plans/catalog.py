"""Imports every query module, so that the registry is full."""

from chromafield.plans import aggregate, io, scalar, spatial, stream, temporal  # noqa: F401
from chromafield.plans.bindings import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES"]
