"""Column functions and small building blocks that operators share."""
