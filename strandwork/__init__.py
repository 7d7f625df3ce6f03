"""strandwork: peptide-library and corpus analytics expressed as lazy Spark DataFrames."""
