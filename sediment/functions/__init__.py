"""Column functions: hashing, paths, formats and codes."""

from .formats import (
    bits_per_byte, filter_byte, filter_name, filter_of_name, format_bytes, format_duration, method_name, parse_size, rate, ratio, saved_percent,
    size_is_sane, thread_plan, working_set,
)
from .hashing import checksum, content_id, content_id_hex
from .paths import archive_path, is_unsafe, report_extension, selects, sort_extension

__all__ = [
    "archive_path", "bits_per_byte", "checksum", "content_id", "content_id_hex", "filter_byte", "filter_name", "filter_of_name", "format_bytes",
    "format_duration", "is_unsafe", "method_name", "parse_size", "rate", "ratio", "report_extension", "saved_percent", "selects", "size_is_sane",
    "sort_extension", "thread_plan", "working_set",
]
