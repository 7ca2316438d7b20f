"""Batch jobs that turn a retail transaction log into next-week purchase recommendations."""
