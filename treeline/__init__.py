"""Trees, graphs and rules over columnar node tables on Spark."""
