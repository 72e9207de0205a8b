"""Sources and sinks of dictionaries, frequency files and JSON stores."""
