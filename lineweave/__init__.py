"""Record linkage and analytics for two descriptions of one network, on Spark."""
