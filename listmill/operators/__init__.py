"""DataFrame to DataFrame steps, meant for ``df.transform``."""
