"""Column expressions: text, paths, patterns, timestamps. They serve batch and stream alike."""
