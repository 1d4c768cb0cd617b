from tenura.sources.csv_files import (
    file_guard,
    file_status,
    ingest_summary,
    nullify_tokens,
    require_rows,
    scan_csv,
)
from tenura.sources.tables import events_as_transactions, orders_as_transactions

__all__ = [
    "events_as_transactions",
    "file_guard",
    "file_status",
    "ingest_summary",
    "nullify_tokens",
    "orders_as_transactions",
    "require_rows",
    "scan_csv",
]
