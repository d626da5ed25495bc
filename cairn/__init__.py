"""cairn: content-addressed snapshot analytics, expressed as Spark DataFrame operators."""
