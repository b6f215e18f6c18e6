"""Column expressions: attributes, polylines, boxes, projections; and Arrow kernels where expressions don't reach."""
