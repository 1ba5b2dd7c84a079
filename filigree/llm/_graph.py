"""Connected components, from the engine's operators."""

from filigree.operators.components import components

__all__ = ["components"]
