"""Part of the market-data library."""
