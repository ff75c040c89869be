"""Integration, quality control and analysis of environmental measurements on Spark."""
