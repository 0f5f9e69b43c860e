"""Sources and sinks (S1-S5): Parquet in, Parquet out."""

from aletheia.sources.parquet import (  # noqa: F401
    TABLES,
    load_table,
    read_table,
    save_table,
    write_generations,
    write_wide_generations,
)
