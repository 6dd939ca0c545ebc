"""tidelog operators."""
