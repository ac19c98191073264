"""Training-data operators: one module each, independent of the rest of the library."""
