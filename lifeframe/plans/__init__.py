"""Whole studies composed of the operators; each is one lazy plan up to the matching."""
