"""DataFrame operators over track tables."""
