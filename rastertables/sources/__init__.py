"""Listings, notifications, keyed state and exports."""
