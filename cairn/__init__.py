"""cairn: manifest analytics as Spark DataFrame operators."""
