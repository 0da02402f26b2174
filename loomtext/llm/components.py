"""Connected components, as in the core's operators."""

from __future__ import annotations

from loomtext.operators.components import connected_components as connected_components
