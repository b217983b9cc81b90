"""DataFrame operators over encoded states, series, fields, graphs and point clouds."""
