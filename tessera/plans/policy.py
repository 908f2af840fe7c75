"""What a comparison of schemas forbids and allows."""

from __future__ import annotations

from dataclasses import dataclass

from tessera.errors import SchemaPolicyError


@dataclass(frozen=True)
class Policy:
    """All flags are off by default: names in any case, columns in any order, types promoted to a common one."""

    # Names and structure.
    case_sensitive_column_names: bool = False
    strict_column_ordering: bool = False
    allow_extra_columns_in_result: bool = False
    strict_struct_field_ordering: bool = False
    allow_extra_fields_in_structs: bool = False
    # Types: on means that the two sides must agree exactly.
    strict_null_types: bool = False
    strict_int_widths: bool = False
    strict_integer_vs_decimal: bool = False
    strict_decimal_precision: bool = False
    strict_float_widths: bool = False
    strict_large_variants: bool = False
    strict_temporal_units: bool = False
    strict_tz_names: bool = False
    strict_nested_children: bool = False

    def __post_init__(self) -> None:
        for order, extra in (
            ("strict_column_ordering", "allow_extra_columns_in_result"),
            ("strict_struct_field_ordering", "allow_extra_fields_in_structs"),
        ):
            if getattr(self, order) and getattr(self, extra):
                raise SchemaPolicyError(f"{order} fixes every position, so {extra} must be off")

    def fold(self, name: str) -> str:
        """The form in which column names are matched."""
        return name if self.case_sensitive_column_names else name.casefold()
