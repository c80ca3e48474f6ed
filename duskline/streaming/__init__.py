"""Micro-batch and stateful plans."""
