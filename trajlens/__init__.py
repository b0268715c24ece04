"""Analytics over ordered event logs of automated agents, on Spark."""
