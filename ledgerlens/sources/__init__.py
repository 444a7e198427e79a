"""Sources: typed CSV scan, star-schema fixture adapter, header cleaning."""

from ledgerlens.sources.lines import (
    CUSTOMER_TYPES,
    LINE_COLUMNS,
    LINE_SCHEMA,
    NUMERIC_COLUMNS,
    lines_from_tpch,
    read_lines_csv,
    table,
    typed_lines,
)
from ledgerlens.sources.names import clean_name_list, clean_names, snake_name

__all__ = [
    "CUSTOMER_TYPES",
    "LINE_COLUMNS",
    "LINE_SCHEMA",
    "NUMERIC_COLUMNS",
    "clean_name_list",
    "clean_names",
    "lines_from_tpch",
    "read_lines_csv",
    "snake_name",
    "table",
    "typed_lines",
]
