"""End-to-end plans and the driver's query set."""
