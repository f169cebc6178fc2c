"""Readers: bytes or markup to rows. Python where the format is binary or nested, in Arrow batches."""
