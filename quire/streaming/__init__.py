"""Batch and streaming digitisation."""
