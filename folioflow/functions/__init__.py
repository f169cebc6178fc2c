"""Column functions. All are built-in Spark expressions: they stay in the JVM and in whole-stage code."""
