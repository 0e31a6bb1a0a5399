"""Column-level helpers (pure ``Column -> Column`` builders, all JVM-side)."""

from tessera.functions.columns import (
    is_blank, not_blank, blank_to_null, as_names, col_type, is_numeric_type, is_string_type,
)

__all__ = ["is_blank", "not_blank", "blank_to_null", "as_names", "col_type",
           "is_numeric_type", "is_string_type"]
