"""Sources and sinks: transcript scan, record projections, price files, table adapters."""
