"""Streaming extension: snapshots that arrive one after the other. Nothing in the batch operators needs it."""
