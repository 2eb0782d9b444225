"""Training-data operators. Self-contained: nothing else in the package imports this folder."""
