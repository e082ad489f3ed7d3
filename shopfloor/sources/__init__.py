"""File sources and sinks."""

from shopfloor.sources.tables import (  # noqa: F401
    append,
    empty,
    latest_snapshot,
    read_table,
    versions,
    write_snapshot,
)
