"""Column-to-Column functions: likelihood models, sequence and format helpers."""
