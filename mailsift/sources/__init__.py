"""Sources and sinks of mail tables, reports and logs."""
