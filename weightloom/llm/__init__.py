"""Training-data operators: scoring, filtering, de-duplication, packing and archives."""
