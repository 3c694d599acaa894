"""Where rows come from: versioned tables behind a manifest, and external Parquet."""
