"""The row-local operators on streams."""
