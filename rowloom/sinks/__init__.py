"""What takes a built model: LP and MPS text, and a small solver on the driver."""
