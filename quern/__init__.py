"""quern: a knowledge-base and training-data engine built on PySpark DataFrames."""
