"""Column-returning functions; everything here stays in the JVM."""
