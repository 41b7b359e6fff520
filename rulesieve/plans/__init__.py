"""End-to-end plans and renderers."""
