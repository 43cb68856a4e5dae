"""Whole plans: a suite, a comparison, what-ifs, drills, robustness, manifests."""
