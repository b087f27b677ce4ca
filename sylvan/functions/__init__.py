"""Column functions: every one returns a Column built from JVM-side expressions."""
from .columns import blank_to_null, dirname, lower_ascii, normalize_list, plain_path, test_key

__all__ = ["blank_to_null", "dirname", "lower_ascii", "normalize_list", "plain_path", "test_key"]
