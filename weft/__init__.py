"""weft — configuration-driven record ⇄ FHIR-resource mapping on Spark."""
