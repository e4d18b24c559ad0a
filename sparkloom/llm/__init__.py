"""Training-data operators: each module holds one operator and is usable alone."""
