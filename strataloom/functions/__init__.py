"""Part of strataloom."""
