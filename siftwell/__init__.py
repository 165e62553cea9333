"""Data profiling, data contracts and mapping suggestion as DataFrame programs."""
