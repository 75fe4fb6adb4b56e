"""Operators of residual analysis: bins, histograms, split search, patches, scores and logs."""
