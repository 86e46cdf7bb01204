"""Record linkage and set selection as composable Spark DataFrame operators."""
