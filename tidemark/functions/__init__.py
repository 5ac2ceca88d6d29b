"""SQL building blocks."""
