"""Column-expression libraries (JVM-side; no Python in the hot path)."""
