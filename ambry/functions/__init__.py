"""Column functions: plain expressions, evaluated inside the JVM."""
