"""Named queries: operators bound to the driver's tables."""
