"""Part of marketloom."""
