"""Maps on streams."""
