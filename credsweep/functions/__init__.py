"""Column-level functions: text scalars, decoders, escape normalization, regex dialect."""
