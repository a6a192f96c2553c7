"""Message-risk analytics on Spark: features, scores and reports over message tables."""

from msgrisk.plans.assess import assess
from msgrisk.registry import Registry

__all__ = ["Registry", "assess"]
