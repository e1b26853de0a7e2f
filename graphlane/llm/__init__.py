"""Training-data operators over text tables. Nothing outside this package imports it."""
