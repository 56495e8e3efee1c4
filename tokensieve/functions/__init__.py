"""Column functions: tones, word classes, text metrics.  All are built-in SQL expressions."""
