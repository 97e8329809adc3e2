"""Training-data operators: thirteen corpus operations, each usable alone, plus their registered queries."""
