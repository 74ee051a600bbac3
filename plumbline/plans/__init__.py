"""Registered queries; importing the modules enters them."""
