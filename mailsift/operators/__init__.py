"""Table operators: quality checks, ordering, splits, corpora, metrics, augmentation."""
