"""tidelog streaming."""
