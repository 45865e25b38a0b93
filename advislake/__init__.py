"""advislake: security-advisory triage as Spark DataFrame operators."""
