"""Training-data pipeline operators: ten independent operators and their queries."""
