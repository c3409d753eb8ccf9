"""textloom: paired-corpus statistics and is-a graph analytics as Spark DataFrame operators."""
