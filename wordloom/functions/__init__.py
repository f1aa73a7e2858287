"""Column functions over texts, readings and labels."""
