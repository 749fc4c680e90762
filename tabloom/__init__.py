"""tabloom: leakage-safe feature engineering and tabular analytics as Spark plans."""

__version__ = "0.1.0"
