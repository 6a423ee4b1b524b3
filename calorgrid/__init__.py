"""calorgrid: a PySpark-native engine for planning and auditing district pipe networks."""
