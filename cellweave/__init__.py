"""Quantity-to-table alignment and corpus analytics as DataFrame operators."""
