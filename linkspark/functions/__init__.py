"""Column functions: encoding, scores, numbers, rings."""
