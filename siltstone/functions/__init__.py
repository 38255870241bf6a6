"""Part of Siltstone."""
