"""The named analytical queries, as functions of frames."""
