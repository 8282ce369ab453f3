"""Readers and writers: JSON lines, zip members, Kaldi lists, manifests, configuration."""
