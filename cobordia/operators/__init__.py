"""Operators on cell complexes, signals and agents: DataFrame in, DataFrame out."""
