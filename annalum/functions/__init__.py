"""Column expressions: years, places, scores, texts. All stay in the JVM but those of `python_only`."""
