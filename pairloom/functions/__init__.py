"""Column expressions. All run inside the JVM; none is a Python UDF."""
