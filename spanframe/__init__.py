"""Frame-sequence analytics as composable Spark DataFrame functions."""
