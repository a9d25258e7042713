"""DataFrame operators: time series, joins, regions, visibility, siting, registration, modelling."""
