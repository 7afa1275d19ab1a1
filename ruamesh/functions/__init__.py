"""Column builders: geometry, classification, units and text helpers."""
