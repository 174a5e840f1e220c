"""The domain on the driver's tables, and the queries over it."""
