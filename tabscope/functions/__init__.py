"""Column-expression building blocks: missing values, type classes, statistics,
datetime parsing and global ordering helpers."""
