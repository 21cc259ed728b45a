"""The core's per-key streaming, under the name the text operators use."""

from vitalframe.operators.partitions import over_keys

__all__ = ["over_keys"]
