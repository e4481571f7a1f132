"""Physical helpers shared by the operators: lineage cuts, skew-safe joins, distributed ranks."""
