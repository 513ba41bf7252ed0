"""Registered queries of the reference's operators and their SQL."""

from . import people, relational, texts
from .fixtures import ORACLES, QUERIES
from .texts import vf2


def oracles() -> dict[str, str]:
    return dict(ORACLES)


__all__ = ["QUERIES", "oracles", "people", "relational", "texts", "vf2"]
