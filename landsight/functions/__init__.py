"""Column expressions: colour, geometry, encodings, frame quality."""
