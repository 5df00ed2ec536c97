"""Column functions: expressions that stay in the JVM."""
