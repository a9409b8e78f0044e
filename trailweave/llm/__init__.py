"""Operations of a training-data pipeline: sharding, scans, filters, deduplication, packing."""
