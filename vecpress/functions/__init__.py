"""Column expressions, all within the JVM."""
