"""Retrieval over versioned, citable documents as DataFrame plans."""
