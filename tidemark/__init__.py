"""A feedback-analytics engine as Spark jobs: DataFrames in, DataFrames out."""
