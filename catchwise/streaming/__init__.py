"""Streaming forms of the half-month climate, the water balance and the input guards."""
