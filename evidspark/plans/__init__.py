"""The engine facade and the registered queries."""
