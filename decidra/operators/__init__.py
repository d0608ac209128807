"""DataFrame operators: joins, similarity, components, dedup, splits, samples, metrics, audit."""
