"""Expected results as SQL, written apart from the Spark code."""
