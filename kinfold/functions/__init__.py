"""Scalar column functions, all evaluated in the JVM."""
