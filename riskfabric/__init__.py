"""riskfabric: supply-chain risk analytics as PySpark DataFrame operators."""
