"""Analytics over digitised land-registration certificates, on Spark."""
