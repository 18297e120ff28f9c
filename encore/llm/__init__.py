"""Training-data operators. Nothing outside this package (and the pipeline at the repository top) imports it."""
