"""Driftwell: moving tables between two data systems with Spark, and proving the move correct."""
