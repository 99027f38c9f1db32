"""Table operators: profiling, encoding, value tiers, decision fidelity, privacy."""
