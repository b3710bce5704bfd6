"""Screens and the distributed building blocks they share."""
