"""Sources and sinks: labelled text, models and metrics."""
