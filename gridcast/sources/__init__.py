"""Readers and writers for the formats the engine meets."""
