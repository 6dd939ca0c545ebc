"""tidelog sources."""
