"""Relational operators: grids, batches, runs, votes, policies, layout. DataFrame in, DataFrame out."""
