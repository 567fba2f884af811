"""Column functions: everything here is built-in Spark expressions, evaluated in generated code."""
