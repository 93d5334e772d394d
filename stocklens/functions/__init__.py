"""Column measures, classifications and their labels."""
