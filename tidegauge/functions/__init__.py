"""Column expressions shared by the operators."""

from tidegauge.functions.columns import (
    epoch_ms,
    finite,
    norm_label,
    norm_name,
    norm_token,
    usable_number,
)

__all__ = ["epoch_ms", "finite", "norm_label", "norm_name", "norm_token", "usable_number"]
