"""docketry: point-in-time analytics over filing records, as Spark DataFrame operators."""
