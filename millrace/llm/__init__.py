"""Training-data operators: each module is one operator; queries.py holds their registered queries."""
