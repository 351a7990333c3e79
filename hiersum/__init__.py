"""A DataFrame engine for hierarchical sums over large point sets.

For every target it computes the sum over all sources of a decaying
interaction, exactly for near boxes and through box expansions for far ones.
"""

from .config import SpatialConfig

__all__ = ["SpatialConfig"]
