"""Column functions."""

from importflow.functions.scalar import (  # noqa: F401
    backoff_seconds, clamp, default_to, email_matches, object_key_parts, page_count,
    report_key, row_hash, row_id, source_key, trim_to_null,
)
