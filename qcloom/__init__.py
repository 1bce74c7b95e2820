"""qcloom: content quality control as Spark DataFrame operators."""
