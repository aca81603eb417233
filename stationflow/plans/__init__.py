"""End-to-end jobs that chain the operators and write the product tables."""
