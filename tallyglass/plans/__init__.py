"""Reports: compositions of operators, one lazy plan per output table."""
