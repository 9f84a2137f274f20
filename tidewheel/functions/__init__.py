"""Part of tidewheel."""
