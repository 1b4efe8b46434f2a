"""reachset: radius coverage on spatial networks, expressed as Spark DataFrame plans."""
