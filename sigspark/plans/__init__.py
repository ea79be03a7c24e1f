"""Feature tables, panels, models and evaluation as lazy plans."""
