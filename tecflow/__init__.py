"""tecflow: satellite-navigation disturbance analytics as Spark DataFrame plans."""
