"""Column expressions. Everything here is built from Spark SQL functions and stays in the JVM."""
