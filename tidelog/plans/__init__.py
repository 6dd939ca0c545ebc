"""tidelog plans."""
