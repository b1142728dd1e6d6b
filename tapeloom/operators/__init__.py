"""Operators over tables of trades, cells, bars, signals, fills and runs."""
