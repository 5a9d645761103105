"""The registered queries; importing the package registers all of them."""

from ambry.plans import browse, flows, fuzzy, indexed, indexing, linking, ordered, reports, search, texts, titles  # noqa: F401
from ambry.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
