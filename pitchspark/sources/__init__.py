"""Reading snapshots and feeds; replacing and merging stored tables."""
