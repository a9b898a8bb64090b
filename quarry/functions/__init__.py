"""Wire primitives, the type system and its mapping to Spark."""
