"""Readers, the synthetic generator, report sinks and the policy store."""
