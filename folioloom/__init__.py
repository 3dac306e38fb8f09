"""folioloom: corpus preparation and terminology work as PySpark DataFrame operators."""
