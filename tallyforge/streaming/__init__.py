"""Windows, deduplication and upserts over streams; an extension of the batch operators."""
