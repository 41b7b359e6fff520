"""Readers of rule packs and corpora."""
