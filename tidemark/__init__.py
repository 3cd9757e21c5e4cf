"""Customer-behaviour analytics on Spark: feature blocks, encoders, blending, diagnostics."""
