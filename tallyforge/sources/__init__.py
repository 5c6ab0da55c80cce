"""Reading records and configs, ingesting them, and writing results."""
