"""Tables in and out, generators, parameters."""
