"""Types, distances and other small functions that the operators share."""
