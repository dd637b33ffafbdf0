"""Part of tidemill; see the modules."""
