"""Analytics for city-scale data as DataFrame operators."""
