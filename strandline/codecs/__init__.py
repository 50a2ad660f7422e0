"""Part of strandline; see the modules."""
