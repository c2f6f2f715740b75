"""Part of shapeloom."""
