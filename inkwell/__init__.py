"""inkwell: text-correction analytics as Spark DataFrame programs."""
