"""Label-efficient table labelling and evaluation on Spark DataFrames."""
