"""rowforge: partner file intake, mapping and normalization as Spark jobs."""
