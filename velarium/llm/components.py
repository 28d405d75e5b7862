"""Connected components of links."""

from velarium.operators.components import components

__all__ = ["components"]
