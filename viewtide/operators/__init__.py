"""The jobs' building blocks: DataFrames in, DataFrames out."""
