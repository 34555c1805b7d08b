"""Plans composed of operators: audit, candidate runs, stage roll-up, and the driver's queries."""
