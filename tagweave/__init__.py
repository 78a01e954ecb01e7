"""tagweave: instrument and equipment tags from engineering drawings, on Spark."""
