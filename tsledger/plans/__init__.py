"""Versions as files: manifests, and the plans that read them."""
