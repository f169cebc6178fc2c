"""Whole flows made of sources and operators."""
