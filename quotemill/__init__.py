"""Market-data candles, indicators and scanners as Spark DataFrame transforms."""
