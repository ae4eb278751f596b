"""Query plans: what the driver and the benchmark run."""
