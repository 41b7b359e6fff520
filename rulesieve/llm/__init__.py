"""Training-data operators over texts and records. Nothing else in the library imports this package."""
