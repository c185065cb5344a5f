"""Recovers the latest human-written message from tables of e-mail documents."""
