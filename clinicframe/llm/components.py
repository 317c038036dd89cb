"""Connected components, under the name that the operators of this folder use."""

from clinicframe.operators.components import components

__all__ = ["components"]
