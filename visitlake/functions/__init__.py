"""Column functions, row predicates and time ranges."""
