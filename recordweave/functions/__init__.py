"""Part of recordweave."""
