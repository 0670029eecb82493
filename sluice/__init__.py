"""Record dataflows on Spark: filters, shaping, validation, changes and streams."""
