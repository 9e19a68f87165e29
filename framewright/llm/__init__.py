"""Training-data operators: near-duplicates, filters, tokens. Nothing else in the library imports this subpackage."""
