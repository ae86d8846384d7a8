"""Column expressions; all but the p-values stay inside the JVM."""
