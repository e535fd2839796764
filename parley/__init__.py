"""Analytics of message timelines and corpora as Spark DataFrame programs."""
