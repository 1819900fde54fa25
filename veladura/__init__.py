"""veladura: protects, reveals, looks up, displays, audits and verifies personal data in Spark."""
