"""Column functions and small reusable dataflow building blocks."""
