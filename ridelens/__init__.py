"""Trip analytics for shared-mobility rides, written as Spark DataFrame plans."""
