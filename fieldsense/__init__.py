"""Analytics over labelled field recordings, as Spark DataFrame plans."""
