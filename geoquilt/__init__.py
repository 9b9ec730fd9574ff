"""geoquilt: Gaussian-process likelihoods for large point sets, as Spark plans."""
