"""Column functions: text and JSON, numbers and plane geometry."""
