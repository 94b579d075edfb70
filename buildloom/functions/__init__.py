"""Scalar functions as column expressions; all run inside the JVM."""
