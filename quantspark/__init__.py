"""Quantity take-off from CAD drawings, as DataFrame plans over many drawings at once."""
