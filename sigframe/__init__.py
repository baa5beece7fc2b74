"""sigframe: sampled-signal and event-grid analytics as lazy PySpark DataFrame operators."""
