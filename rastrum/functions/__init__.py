"""Windows and scalar formulas."""
