"""Analytics over large collections of written reports, as Spark DataFrames."""
