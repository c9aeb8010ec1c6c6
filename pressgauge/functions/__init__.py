"""Column functions and, where built-ins cannot express the semantics, Arrow UDFs."""
