"""Column functions: vectors, sets of evidence, text, frame quality."""
