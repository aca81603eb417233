"""The operators instantiated on the driver's tables, each with its SQL twin."""
