"""Column functions: vectors, boxes, and small text and number rules."""
