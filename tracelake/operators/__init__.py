"""DataFrame operators over packets, messages, flows and metric series."""
